"""A tree on disk as a stream of its changes."""

import os

import pytest

from sparkwarden.operators.hypotheses import build_hypotheses
from sparkwarden.operators.proposals import build_proposals, signals_of
from sparkwarden.sources import changes as C
from sparkwarden.streaming import jobs

AS_OF = "2024-01-01 00:00:00"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()

    def put(**files):
        for name, text in files.items():
            path = root / name.replace("__D__", "/").replace("__P__", ".")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.unlink() if text is None else path.write_bytes(text)

    return root, put


def run(spark, root, state, out, checkpoint):
    make = lambda stream: jobs._start(jobs._per_batch(stream, lambda batch, _: batch, out), checkpoint, None)
    return C.follow_tree(spark, str(root), state, make)


def rows(spark, root, out):
    found = jobs.read_batches(spark, out).collect()
    return sorted((r.batch_id, r.file_path[len(os.path.realpath(root)) + 1 :], r.content, r.deleted, r.error) for r in found)


def test_new_edited_deleted_and_hidden_files(spark, tree, tmp_path):
    root, put = tree
    state, out, checkpoint = (f"{tmp_path}/{n}" for n in ("state", "out", "ck"))
    put(**{"a.py": b"one", "__init__.py": b"", ".x.py": b"h\r\n", "_d__D__sub dir__D__b.js": b"b\xff", "note.txt": b"no"})
    assert run(spark, root, state, out, checkpoint) == 1
    # nothing changed: no listing, no batch
    assert run(spark, root, state, out, checkpoint) == 1
    put(**{"a.py": b"two!", ".x.py": None, "new.ts": b"n"})
    assert run(spark, root, state, out, checkpoint) == 2
    put(**{"a.py": b"six!", "__init__.py": None})
    put(**{"__init__.py": b"x"})
    os.utime(root / "a.py", ns=(1, 1))
    assert run(spark, root, state, out, checkpoint) == 3
    assert rows(spark, root, out) == sorted([
        (0, "a.py", "one", False, None), (0, "__init__.py", "", False, None), (0, ".x.py", "h\n", False, None), (0, "_d/sub dir/b.js", "b�", False, None),
        (1, "a.py", "two!", False, None), (1, ".x.py", None, True, None), (1, "new.ts", "n", False, None),
        (2, "a.py", "six!", False, None), (2, "__init__.py", "x", False, None),
    ])
    # another reader starts from the first listing and gets the changes of all, as contents are now
    run(spark, root, state, f"{tmp_path}/out2", f"{tmp_path}/ck2")
    again = rows(spark, root, f"{tmp_path}/out2")
    assert len(again) == 9 and {r[0] for r in again} == {0} and [r[2] for r in again if r[1] == "a.py"] == ["six!"] * 3
    assert [r[4] is not None for r in again if r[1] == ".x.py"].count(True) == 1


def test_listing_that_broke_off(spark, tree, tmp_path):
    root, put = tree
    state = f"{tmp_path}/state"
    put(**{"a.py": b"1"})
    C.refresh_listing(spark, str(root), state)
    put(**{"b.py": b"2", "c.py": b"3"})
    C.refresh_listing(spark, str(root), state)
    # as if the driver had been lost before the mark
    os.remove(f"{state}/done/2")
    assert C.last_listing(state) == 1
    put(**{"c.py": None})
    assert C.refresh_listing(spark, str(root), state, files_per_part=1) == 2
    reader = C.ChangesReader(state)
    assert reader.initialOffset() == {"listing": 0} and reader.latestOffset() == {"listing": 2}
    names = lambda a, b: sorted(os.path.basename(r["file_path"]) for p in reader.partitions({"listing": a}, {"listing": b}) for x in reader.read(p) for r in x.to_pylist())
    assert (names(0, 1), names(1, 2), names(2, 2)) == (["a.py"], ["b.py"], [])


def test_hypotheses_of_a_changing_tree(spark, corpus, tree, tmp_path):
    root, put = tree
    state, out, checkpoint = (f"{tmp_path}/{n}" for n in ("state", "out", "ck"))
    start = lambda stream: jobs.hypothesis_stream(stream, out, checkpoint, AS_OF, compact_every=2)
    for files in (
        {"a.py": b'm = "gpt-4"', "b.py": b'm = "gpt-4"', "c.py": b'm = "gpt-4"'}, {"a.py": b'org_id = "acme"', "b.py": None},
        {"c.py": b"clean"}, {"d.py": b'u = "http://localhost"'},
    ):
        put(**files)
        C.follow_tree(spark, str(root), state, start)
    now = {"a.py": 'org_id = "acme"', "c.py": "clean", "d.py": 'u = "http://localhost"'}
    want = build_hypotheses(signals_of(build_proposals(corpus(now, os.path.realpath(root)), AS_OF)))
    got = jobs.latest_hypotheses(spark, out).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
