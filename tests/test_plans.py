"""Plans that the README states, and rows that must not depend on them."""

from conftest import seg_df
from shroud.operators.detect import detect_regex, explode_spans
from shroud.operators.hybrid import detect_distinct, hybrid_spans, predicted, predictions, segment_spans
from shroud.operators.redact import redact_found
from shroud.session import stored


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dictionary(spark):
    return spark.createDataFrame([("Ann Lee", "PERSON"), ("Acme Corp", "ORG")], "entry string, label string")


def test_detection_and_redaction_do_not_shuffle_text(spark):
    segs = stored(seg_df(spark, ["Ann Lee of Acme Corp, a@b.co", "nothing", ""]))
    assert "Exchange" not in plan_of(predictions(hybrid_spans(segs, dictionary(spark))))
    found = stored(segment_spans(segs, dictionary(spark)).withColumn("spans", predicted()))
    plan = plan_of(redact_found(found))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_hot_text_is_detected_once_and_given_to_all(spark):
    """A text that half of all rows repeat, texts that are repeated without a hit, single ones, empty and null ones."""
    texts = ["mail a@b.co or 123-45-6789"] * 300 + ["no hit here"] * 50 + [f"x{k}@mail.example.com" for k in range(100)] + ["", "", None, None]
    segs = seg_df(spark, texts).repartition(5)
    ran = spark.sparkContext.accumulator(0)

    def counted(df):
        rows = df.rdd.map(lambda r: (ran.add(1 if r.text else 0), r)[1])
        return detect_regex(spark.createDataFrame(rows, df.schema))

    got = sorted(tuple(r) for r in explode_spans(detect_distinct(segs, counted)).collect())
    assert ran.value == 102  # the distinct texts
    assert got == sorted(tuple(r) for r in explode_spans(detect_regex(segs)).collect())


def test_corpus_stats_stores_nothing(spark, monkeypatch):
    """Before, all predictions were written to be read once."""
    from shroud.plans import queries

    monkeypatch.setattr(queries, "stored", None)
    got = queries.q_corpus_stats(spark, "/root/testdata/sf0.001").first()
    assert got.n_documents > 0 and got.n_segments > got.n_documents and got.n_unique_values > 0
