"""Benchmark rows that share an id."""

from textloom.llm import decontaminate


def test_wordings_of_one_item_are_all_compared(spark):
    """Rows of one item_id that differ around the seed, in either order."""
    core = [f"w{i}" for i in range(10)]
    doc = [f"l{i}" for i in range(5)] + core + [f"r{i}" for i in range(5)]
    other = [f"x{i}" for i in range(5)] + core + [f"y{i}" for i in range(5)]
    docs = spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string")
    for rows in ([doc, other], [other, doc]):
        bench = spark.createDataFrame([(9, " ".join(r)) for r in rows], "item_id long, text string").coalesce(1)
        got = [(r.doc_id, r.item_id, r.matched) for r in decontaminate.overlaps(docs, bench).collect()]
        assert got == [(1, 9, 20)]
