import numpy as np
from pyspark.sql import functions as F

from folioflow.functions import bytes as BY
from folioflow.sources import files


def test_import_plan(spark, tmp_path):
    for n, c in (("a b.pdf", b"one"), ("b.pdf", b"one"), ("c.pdf", b"two"), ("d.txt", b"three")):
        (tmp_path / n).write_bytes(c)
    import hashlib

    have = spark.createDataFrame([(hashlib.sha256(b"two").hexdigest(), True)], "sha256 string, isTrashed boolean")
    got = {r.title: r.action for r in files.import_plan(spark, str(tmp_path), have).collect()}
    assert got == {"a b": "NEW", "c": "RESTORE"}


def test_publish_overwrites_only_touched_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    files.publish(spark.createDataFrame([("d1", 1), ("d2", 2)], "documentId string, v int"), p, ["documentId"])
    files.publish(spark.createDataFrame([("d2", 3)], "documentId string, v int"), p, ["documentId"])
    assert sorted((r.documentId, r.v) for r in spark.read.parquet(p).collect()) == [("d1", 1), ("d2", 3)]


def test_text_layers_and_needle(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"pages":[]}\n')
    t = files.text_layers(spark, str(tmp_path))
    assert files.containing(t, "json", "pages").count() == 1 and files.containing(t, "json", "none").count() == 0 and files.containing(t, "json", None).count() == 1


def test_bytes(spark):
    table = BY.byte_of_character()
    assert sorted(table.values()) == list(range(256))
    back = {b: c for c, b in table.items()}
    vocab = ["<s>", "<p>", "</s>", "<u>", "<m>", *["".join(back[b] for b in t.encode()) for t in ("é", " x")]]
    assert BY.detokenize([0, 5, 6, 99], vocab) == "é x"
    d = spark.createDataFrame([([5, 6],), (None,)], "ids array<int>")
    assert [r.t for r in d.select(BY.detokenized(F.col("ids"), vocab).alias("t")).collect()] == ["é x", None]
    bits = np.array([1.5, -2.0], np.float16).view(np.uint16).tolist()
    assert spark.createDataFrame([(bits,)], "b array<int>").select(BY.half_values(F.col("b")).alias("f")).first()["f"] == [1.5, -2.0]
