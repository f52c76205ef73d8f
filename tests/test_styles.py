"""Style sheets on planted cases: tokenizer, colours in every notation, counters and signatures."""

import time

import pytest

from evalgrid.functions import styles
from evalgrid.plans import sites


def test_declarations():
    css = """/* a { color: red } */ @import url("x;y.css"); body{COLOR:Red;background:url(data:a;b) no-repeat}
    @media (max-width: 3px) { .a:hover { float: left; --own: 1px } .b { content: "};:" ; } margin: 0 }
    .c { x ; : y; color:; width:10px"""
    assert list(styles.read(css)) == [("color", "red"), ("background", "url(data:a;b) no-repeat"), ("float", "left"), ("--own", "1px"), ("content", '"};:"'), ("margin", "0"), ("width", "10px")]
    assert list(styles.read(None)) == [] and list(styles.read("a:hover, b { }")) == []


@pytest.mark.parametrize(
    "value, want",
    [
        ("#F00 solid".lower(), [(255, 0, 0, "hex3")]), ("#336699", [(51, 102, 153, "hex6")]), ("#33669980", [(51, 102, 153, "hex6")]), ("#abcde", []), ("rgb(1, 2, 300)", [(1, 2, 255, "rgb")]),
        ("rgba(50% 0% 100% / .5)", [(128, 0, 255, "rgb")]), ("hsl(120, 100%, 50%)", [(0, 255, 0, "hsl")]), ("hsla(240deg 100% 25% / 1)", [(0, 0, 128, "hsl")]), ("rgb(var(--x))", []),
        ("1px solid red", [(255, 0, 0, "named")]), ("url(red-box.png) navy", [(0, 0, 128, "named")]), ("linear-gradient(#fff, gold)", [(255, 255, 255, "hex3"), (255, 215, 0, "named")]),
    ],
)
def test_colours(value, want):
    assert list(styles.colours_of(value)) == want


def test_hostile_sheets():
    for unit in ("{", "a:", '"', "/*", "(", "'\\", "a{b:c;", "url(", "}"):
        begun = time.perf_counter()
        list(styles.read(unit * (200_000 // len(unit))))
        assert time.perf_counter() - begun < 5, unit


def test_signature_of_planted_sheets(spark):
    page = "<!DOCTYPE html><html><head><style>{}</style></head><body><nav><a>x</a></nav><table></table></body></html>"
    rows = [("reds", page.format("a{color:#f00;border:1px solid #F00} b{float:left;font-family:'Georgia', serif;font-size:12pt}")), ("reds", "<p>plain</p>"), ("blue", page.format("p{color:hsl(240,100%,50%);background:white;display:flex}")), ("none", "<p>x</p>"), ("none", None)]
    got = {r["by"]: (r["doctype"], {b: r["blocks"][b].asDict() for b in r["blocks"].__fields__}) for r in sites.signatures(spark.createDataFrame(rows, "by string, html string"), "by").collect()}
    assert {k: v[0] for k, v in got.items()} == {"reds": "html5", "blue": "html5", "none": "none"}
    reds, blue, none = (got[k][1] for k in ("reds", "blue", "none"))
    assert reds["colour"]["hue_0"] > 0 and all(reds["colour"][f"hue_{k}"] == 0 for k in range(1, 8)) and reds["colour"]["hex3"] == reds["colour"]["mean_saturation"] > 0 and reds["colour"]["named"] == 0
    assert blue["colour"]["hue_5"] > 0 and blue["colour"]["rgb_hsl"] == blue["colour"]["named"] > 0 and blue["layout"]["flex"] > blue["layout"]["fluid_unit"] > 0
    assert reds["layout"]["float"] == 1.0 and reds["font"]["serif"] > 0 and reds["font"]["mono"] == 0 and reds["font"]["pt"] > 0 and reds["structure"]["semantic"] > 0
    assert all(x == 0 for b in ("colour", "font", "layout") for x in none[b].values())
    for block in (*reds.values(), *blue.values()):
        assert abs(sum(x * x for x in block.values()) - 1) < 1e-4 or not any(block.values())
