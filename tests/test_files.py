"""Readers of result files on the known-answer tree, and on odd files."""

import csv
import json

from evalgrid.sources import files

#: Task, seed, suffix, rewards of both trials, steps, error, and whether the second trial ran the episode anew.
EPISODES = [(1, 10, "", 1, 1, 5, "", False), (2, 11, "", 0, 1, 30, "", True), (3, 12, "", 0, 0, 12, "", True), (3, 12, "_0", 1, 1, 9, "", False), (4, 13, "", 0, 0, 2, "boom: TimeoutError", False)]


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


def tree(root):
    study = root / "results" / "model" / "1_all"
    for trial in (1, 2):
        rows = []
        for task, seed, suffix, r1, r2, steps, err, again in EPISODES:
            stamp = f"2026-07-2{trial if again else 1}_00-43-37"
            rows.append([f"/x/{stamp}_agent_on_run.{task}_{seed}{suffix}", f"run.{task}", float(seed), (r1, r2)[trial - 1], float(steps), err, "True" if steps < 30 else "", "yes" if steps == 30 else "0"])
        write(study / f"result_df_trial_{trial}_of_2.csv", ["exp_dir", "env.task_name", "env.task_seed", "cum_reward", "n_steps", "err_msg", "terminated", "truncated"], rows)
    write(study / "summary_df.csv", ["agent", "avg_reward", "std_err", "n_completed", "n_err"], [["a", 0.1, 0.1, "1/5", 0], ["a", 0.6, 0.2449, "5/5", 1]])
    write(study / "summary_df_old.csv", ["avg_reward", "std_err", "n_completed", "n_err"], [[0.9, 0, "9/9", 9]])
    return study


def test_known_answers_of_the_trial_tree(spark, tmp_path):
    tree(tmp_path)
    assert [(r["trial"], r["of"]) for r in files.trial_files(spark, str(tmp_path)).collect()] == [(1, 2), (2, 2)]
    r = files.read_trials(spark, str(tmp_path)).collect()
    assert len(r) == 5 and sum(x["n_rows"] for x in r) == 10 and len({(x["task_id"], x["seed"]) for x in r}) == 4
    assert sorted(x["n_attempts"] for x in r) == [1, 1, 1, 2, 2] and sum(x["reward"] >= 1 for x in r) == 3
    assert [x["reward"] for x in r if x["task_id"] == 2] == [1.0] and sum(x["err"] for x in r) == 1
    assert sum(x["terminated"] for x in r) == 4 and sum(x["truncated"] for x in r) == 1
    s = files.read_summaries(spark, str(tmp_path)).collect()
    assert [(x["avg_reward"], x["n_completed"], x["n_err"]) for x in s] == [(0.6, "5/5", 1)]
    n = len(r)
    assert abs(sum(x["reward"] for x in r) / n - s[0]["avg_reward"]) < 5e-4


def test_odd_trees(spark, tmp_path):
    assert files.read_trials(spark, str(tmp_path / "missing")).count() == 0 and files.read_summaries(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "empty").mkdir()
    assert files.read_trials(spark, str(tmp_path / "empty")).count() == 0
    write(tmp_path / "odd" / "result_df_trial_1_of_1.csv", ["n_steps", "exp_name", "cum_reward", "note"], [["many", "run.7", "x", "a,b\nc"], ["3.0", "run.7", "1", ""]])
    r = files.read_trials(spark, str(tmp_path / "odd")).collect()
    assert sorted((x["task_id"], x["seed"], x["n_steps"], x["reward"], x["n_attempts"]) for x in r) == [(7, -1, 0, 0.0, 1), (7, -1, 3, 1.0, 1)]


def test_json_and_split_readers(spark, tmp_path):
    rows = [{"task_id": 1, "intent": "a"}, {"task_id": 2, "intent": None}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "tasks.json").write_text(json.dumps({"tasks": rows}))
    (tmp_path / "lines.jsonl").write_text("\n" + json.dumps(rows[0]) + "\n\n  \n" + json.dumps(rows[1]) + "\n")
    for name in ("array.json", "tasks.json", "lines.jsonl"):
        assert [tuple(r) for r in files.read_json_records(spark, str(tmp_path / name), "task_id long, intent string").orderBy("task_id").collect()] == [(1, "a"), (2, None)]
    assert files.read_json_records(spark, str(tmp_path / "none.json"), "task_id long, intent string").count() == 0
    write(tmp_path / "split.csv", ["task_name", "task_id", "sites", "browsergym_split"], [["b.run.4", 9, "wiki,news", "train"], ["b", 5, "shop", "test"], ["b.run.4", 9, "shop", "test"]])
    assert sorted(map(tuple, files.read_split(spark, str(tmp_path / "split.csv")).collect())) == [(4, "shop", "test"), (5, "shop", "test")]


def test_episode_folders(spark, tmp_path):
    for task, steps in ((3, 2), (4, 0)):
        d = tmp_path / "era1" / f"2026-01-01_agent_on_run.{task}_7"
        (d / "training_data").mkdir(parents=True)
        (d / "summary_info.json").write_text(json.dumps({"cum_reward": task / 4, "n_steps": steps, "more": 1}))
        for i in range(steps):
            (d / "training_data" / f"agent_output_step_{i}.{'json' if i else 'txt'}").write_text("{}")
    got = [tuple(r) for r in files.scan_episodes(spark, str(tmp_path)).collect()]
    assert [r[1:] for r in got] == [(3, 7, 0.75, 2, 2), (4, 7, 1.0, 0, 0)]
