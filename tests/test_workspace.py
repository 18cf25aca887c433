"""Refresh end to end: deltas follow the files, a stopped refresh goes on where it was."""

import pytest

from tessera.operators import lexical
from tessera.operators.workspace import Stage, StageLog, Workspace, refresh


def embedder(texts):
    return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]


@pytest.fixture
def repo(spark, tmp_path):
    folder = tmp_path / "repo"
    (folder / "src").mkdir(parents=True)
    (folder / "src" / "ledger.py").write_text("def post_entry(amount):\n    return amount\n")
    (folder / "src" / "money.py").write_text("class Currency:\n    symbol = 'x'\n")
    (folder / "src" / "blob.py").write_bytes(b"\x00\x01binary")
    (folder / "src" / "old.py").write_bytes("# Gr\xf6\xdfe of an amount\n".encode("latin-1"))
    (folder / "notes.txt").write_text("post_entry is not code here")
    (folder / "guide.md").write_text("# Guide\n\nHow a gateway posts an entry.\n")
    ws = Workspace(spark, str(tmp_path / "ws"), embedder, 3, buckets=4)
    ws.folders["team/ledger"] = str(folder)
    return ws, folder


def found(ws, kind, words):
    return {r.path for r in ws.text[kind].search(lexical.parse(words)).collect()}


def test_indexes_follow_the_files(repo):
    ws, folder = repo
    assert ws.refresh("team/ledger") == {"code_text": "done", "code_vectors": "done", "docs_text": "done", "docs_vectors": "done"}
    assert found(ws, "code", "amount") == {"src/ledger.py", "src/old.py"} and found(ws, "docs", "gateway") == {"guide.md"}
    assert found(ws, "code", "binary") == set()
    before = ws.vectors["code"].version().number
    assert ws.update_text("code", "team/ledger") == 0 and ws.update_vectors("code", "team/ledger") == 0
    assert ws.vectors["code"].version().number == before  # nothing changed, nothing written
    (folder / "src" / "ledger.py").write_text("def post_entry(total):\n    return total\n")
    (folder / "src" / "money.py").unlink()
    (folder / "src" / "old.py").unlink()
    (folder / "src" / "rate.py").write_text("rate = 'amount'\n")
    assert set(ws.refresh("team/ledger").values()) == {"done"}
    assert found(ws, "code", "amount") == {"src/rate.py"} and found(ws, "code", "total") == {"src/ledger.py"} and found(ws, "code", "Currency") == set()
    ids = {r.id for r in ws.text["code"].documents().collect()}
    assert {r.id for r in ws.vectors["code"].read().collect()} == ids and len(ids) == 2
    assert {(r.path) for r in ws.files["code"].read().collect()} == {"src/ledger.py", "src/rate.py"}
    ws.remove("team/ledger")
    assert found(ws, "code", "total") == set() and ws.files["code"].read().count() == 0 and ws.log.of("team/ledger") == {}


def test_a_run_that_stopped_before_the_hashes_leaves_nothing_stale(repo, monkeypatch):
    ws, folder = repo
    merge = type(ws.files["code"]).merge
    monkeypatch.setattr(type(ws.files["code"]), "merge", lambda self, *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        ws.update_text("code", "team/ledger")
    monkeypatch.setattr(type(ws.files["code"]), "merge", merge)
    (folder / "src" / "ledger.py").write_text("x = 1\n")
    ws.update_text("code", "team/ledger")
    assert found(ws, "code", "amount") == {"src/old.py"} and found(ws, "code", "x") == {"src/ledger.py", "src/money.py"}


@pytest.mark.parametrize("stop", range(4))
def test_a_stopped_refresh_repeats_no_stage(spark, tmp_path, stop):
    ran, broken = [], {stop}

    def stage(k, needs):
        def step(repo):
            if k in broken:
                raise SystemError("the lights went out")
            ran.append(k)
            return k

        return Stage(f"s{k}", needs, step)

    stages = [stage(0, ()), stage(1, ("s0",)), stage(2, ("s1",)), stage(3, ("s0",))]
    log = StageLog(spark, str(tmp_path / "log"))
    first = refresh(log, stages, "r", "run-1")
    assert first[f"s{stop}"] == "error"
    if stop == 0:
        assert set(first.values()) == {"error", "waiting"} and ran == []
    if stop == 1:
        assert first == {"s0": "done", "s1": "error", "s2": "waiting", "s3": "done"}
    done = list(ran)
    broken.clear()
    again = StageLog(spark, str(tmp_path / "log"))  # as after a restart
    assert set(refresh(again, stages, "r", "run-1").values()) == {"done"}
    assert sorted(ran) == [0, 1, 2, 3] and ran[: len(done)] == done
    assert {s: (r["state"], r["rows"]) for s, r in again.of("r").items()} == {f"s{k}": ("done", k) for k in range(4)}
    refresh(again, stages, "r", "run-2", wanted=["s2"], skipped=("s1",))
    assert ran[4:] == [0, 2]


def test_what_was_running_at_a_crash_has_failed(spark, tmp_path):
    log = StageLog(spark, str(tmp_path / "log"))
    log.put("a", "x", "r1", "running")
    log.put("a", "y", "r1", "done", 3)
    log.reconcile()
    assert {s: (r["state"], r["error"]) for s, r in log.of("a").items()} == {"x": ("error", "interrupted"), "y": ("done", None)}
    with pytest.raises(ValueError):
        Workspace(spark, str(tmp_path / "w")).refresh("nobody")
