"""What Python workers hold does not grow with the rows of a task."""

import tracemalloc

import pyarrow as pa

from sparkwarden import prepare
from sparkwarden.queries.registry import _answering, _write_files


def test_answers_hold_one_prompt():
    answer = _answering()
    tracemalloc.start()
    for k in range(300):
        try:
            answer("", str(k) + "x" * 100_000)
        except RuntimeError:
            pass
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1_000_000


def test_answers_count_the_attempts_at_a_task():
    answer = _answering()
    for text in ("a" * 20, "b" * 20, "a" * 20):
        for _ in range(2):
            try:
                answer("", text)
                raise AssertionError("answered too early")
            except RuntimeError:
                pass
        assert '"overall_score":20' in answer("", text)


def test_batches_of_wide_rows_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    wide = spark.range(3000).coalesce(1).selectExpr("repeat('x', 10000) AS prompt")
    prepare(spark)
    assert max(r.n for r in wide.mapInArrow(sizes, "n BIGINT").collect()) < 16_000_000


def test_files_are_written_one_at_a_time(spark, tmp_path):
    class Rows:
        """Runs the task's function here."""

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def agg(self, *_):
            return self

        def collect(self):
            return list(self.run(iter([batch])))

    texts = ["é\r\n" + chr(97 + k) * 1_000_000 for k in range(20)]
    (tmp_path / "gone").write_text("x")
    batch = pa.RecordBatch.from_pydict({"name": [*(f"d/_f{k}" for k in range(20)), "gone", "empty"], "content": [*texts, None, ""]})
    tracemalloc.start()
    _write_files(str(tmp_path), Rows())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(tmp_path / "d" / f"_f{k}").read_bytes() for k in range(20)] == [t.encode() for t in texts]
    assert not (tmp_path / "gone").exists() and (tmp_path / "empty").read_bytes() == b""
    assert peak < 4_000_000
