"""Case state across runs: only what changed is written again."""

from pathlib import Path

from spoor.sinks.writers import read_case_state, update_case_state


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if "case_id=" in str(p)}


def test_a_second_run_writes_one_case(spark, tmp_path):
    def state(rows):
        return {"nodes": spark.createDataFrame(rows, "case_id string, value string, n int")}

    rows = [("a", "x", 1), ("a", "y", None), ("b", "x", 2), (None, "z", 3), ("c", "x", 1), ("c", "x", 1)]
    read = lambda: sorted(map(repr, (tuple(r) for r in read_case_state(spark, str(tmp_path), "nodes").select("case_id", "value", "n").collect())))
    first = update_case_state(state(rows), str(tmp_path))
    assert first == {"nodes": {"written": 4, "cases": 4, "removed": 0}} and read() == sorted(map(repr, rows))
    kept = files_of(tmp_path / "nodes")
    # the same rows in another order are the same state
    again = update_case_state(state(rows[::-1]), str(tmp_path))
    assert again["nodes"]["written"] == 0 and files_of(tmp_path / "nodes") == kept
    # one case changes, one goes, one repeated row becomes a single one
    after = [("a", "x", 1), ("a", "y", 7), (None, "z", 3), ("c", "x", 1)]
    third = update_case_state(state(after), str(tmp_path))
    assert third == {"nodes": {"written": 2, "cases": 3, "removed": 1}} and read() == sorted(map(repr, after))
    now = files_of(tmp_path / "nodes")
    moved = {f.split("case_id=")[1].split("/")[0] for f in kept.keys() ^ now.keys()}
    assert moved == {"a", "c"}
