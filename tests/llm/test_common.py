import pyarrow as pa
from helpers import docs

from sluice.llm import common as C
from sluice.llm import decontaminate, language_id


def batch(*values):
    return pa.RecordBatch.from_arrays([pa.array(values)], ["x"])


def test_a_task_gives_memory_back_at_its_end(monkeypatch):
    seen = []
    monkeypatch.setattr(C, "give_back", lambda: seen.append("given back"))

    def fn(batches):
        yield from batches
        seen.append("ended")
        yield batch(9)

    out = C.giving_back(fn)(iter([batch(1), batch(2, 3)]))
    assert next(out).to_pydict() == {"x": [1]} and not seen
    assert [b.to_pydict()["x"] for b in out] == [[2, 3], [9]] and seen == ["ended", "given back"]


def test_decontamination_starts_no_rows_from_the_driver(spark):
    out = decontaminate.decontaminate(docs(spark, [(1, "a b c")]).filter("doc_id > 0"), spark.sql("SELECT 1L AS item_id, 'one two three four five six seven' AS text"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1  # the test's own table


def test_labels_do_not_depend_on_slices(monkeypatch):
    rows = pa.RecordBatch.from_pydict({"text": ["alpha beta gamma", "", "été où ça", "x" * 50] * 20, "rest": list(range(80))})
    counts = language_id.np.ones((2, language_id.BUCKETS + language_id.SCRIPTS))

    class Held:
        value = language_id.Model(["a", "b"], counts)

    want = pa.Table.from_batches(language_id.label_batches(iter([rows]), Held, 12.0, False, False)).to_pydict()
    monkeypatch.setattr(language_id, "SLICE_CHARS", 100)
    assert pa.Table.from_batches(language_id.label_batches(iter([rows]), Held, 12.0, False, False)).to_pydict() == want
