"""Scratch tables go as soon as no step needs them."""

from tarnwell.llm import suffix_dedup


def test_suffix_dedup_keeps_few_step_tables(spark, monkeypatch):
    texts = ["one long passage that two of the texts share " * 2 + x for x in ("alpha", "beta and more", "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    alive, most = set(), []
    make, drop = suffix_dedup.materialize, suffix_dedup.discard

    def made(df):
        out = make(df)
        alive.add(out._scratch)
        most.append(len(alive))
        return out

    def dropped(*tables):
        alive.difference_update(t._scratch for t in tables if t is not None)
        drop(*tables)

    monkeypatch.setattr(suffix_dedup, "materialize", made)
    monkeypatch.setattr(suffix_dedup, "discard", dropped)
    out = suffix_dedup.remove_repeats(docs, length=40, gram=8, block=4, words=12, word_gram=3, batches=2).collect()
    assert len(out) == 3 and all(r.n_removed > 0 for r in out)
    assert max(most) == 3  # six, when they all stayed to the end of the step
