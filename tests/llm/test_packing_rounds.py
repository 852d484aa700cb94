"""Rounds of packing where a session holds the number of partitions."""

import public_tokenizers

from shoebox.llm import packing


def test_packing_rounds_end_where_partitions_are_held(spark, monkeypatch):
    """Where a session deals keys to more partitions than asked for, the rounds are still a logarithm of the tasks and end in one task."""
    frame = type(spark.range(1))
    dealt, written, cut = frame.repartition, [], packing.cut
    monkeypatch.setattr(frame, "repartition", lambda self, n, *keys: dealt(self, max(n, 40) if keys else n, *keys))
    monkeypatch.setattr(packing, "cut", lambda df, name: written.append((name, held := cut(df, name))) or held)
    rows = [(i, "word " * (1 + 7 * i % 90)) for i in range(240)]
    docs = dealt(spark.createDataFrame(rows, "doc_id bigint, text string"), 40)
    found = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 256).collect()
    assert sorted({r.doc_id for r in found}) == list(range(240))
    moves = [df for name, df in written if name == "moves"]
    assert len(moves) == 2
    assert moves[-1].selectExpr("count(distinct shiftright(bin, 32))").first()[0] == 1
