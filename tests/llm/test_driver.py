"""What training asks of the driver."""

from pyspark.sql import functions as F

from pricelattice.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_training_sends_means_once_and_keeps_no_broadcast(spark, monkeypatch):
    """A moved row of weights comes as one float a weight and square; what was broadcast for a round is destroyed with it."""
    widths, made, gone, gathered, broadcast = set(), [], [], toxicity._gathered, type(spark.sparkContext).broadcast

    def watched(df, name):
        t = gathered(df, name)
        if name == "changes":
            widths.add(-(-t.nbytes // t.num_rows))
        return t

    def sent(sc, value):
        b = broadcast(sc, value)
        made.append(b)
        end = b.destroy
        b.destroy = lambda: (gone.append(b), end())
        return b

    monkeypatch.setattr(toxicity, "_gathered", watched)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", sent)
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    net = toxicity.train(docs, labels, F.lit(True))
    assert net is not None and len(made) > toxicity.ROUNDS
    assert max(widths) <= 4 * (1 + 2 * toxicity.DIM) + 4
    assert {id(b) for b in made} == {id(b) for b in gone}
