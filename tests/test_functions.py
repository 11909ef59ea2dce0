import math
import uuid

from pyspark.sql import functions as F

import pytest

from folioflow.functions import codecs, geometry as G, text as X
from folioflow.functions.diff import changed_ranges
from folioflow.functions.latex import encode_text, encoded, normalize_text


def one(spark, col, **values):
    names = list(values)
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(values[n])]}" for n in names) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(col.alias("r")).first()["r"]


def test_squeeze_and_fence(spark):
    assert one(spark, X.squeeze(F.col("t")), t=" a \n\t b  ") == "a b"
    assert one(spark, X.strip_fence(F.col("t")), t="```json\n{}\n```") == "{}"
    assert one(spark, X.strip_fence(F.col("t")), t=" {} ") == "{}"


def test_name_uuid_is_version_3_without_namespace(spark):
    import hashlib

    for t in ("doc:0:1", "", "é"):
        b = bytearray(hashlib.md5(t.encode()).digest())
        b[6], b[8] = b[6] & 0x0F | 0x30, b[8] & 0x3F | 0x80
        assert one(spark, codecs.name_uuid(F.col("t")), t=t) == str(uuid.UUID(bytes=bytes(b)))


def test_regions_drop_malformed_parts_and_other_pages(spark):
    got = one(spark, codecs.decode_regions(F.col("t"), F.lit(1)), t="1,.1,.2,.3,.4|2,0,0,1,1|1,a,0,1,1|1,2,3|")
    assert [(r["page"], round(r["left"], 3), round(r["bottom"], 3)) for r in got] == [(1, 0.1, 0.4)]
    assert one(spark, codecs.decode_regions(F.col("t")), t=None) is None
    assert one(spark, codecs.encode_regions(codecs.decode_regions(F.col("t"))), t="0,-1,0.25,0.5,2") == "0,0.0,0.25,0.5,1.0"


def test_points_round_trip(spark):
    t = "0.100000,0.200000,0.5000;0.300000,0.400000,1.0000"
    assert one(spark, codecs.encode_points(codecs.decode_points(F.col("t"))), t=t + ";bad;1,2") == t


def test_routes(spark):
    for t in ("library", "reader|d1", "settings", "settings|d1", "note|s1", "vocabulary"):
        r = one(spark, codecs.decode_route(F.col("t")), t=t)
        assert one(spark, codecs.encode_route(F.col("k"), F.col("a")), k=r["kind"], a=r["argument"]) == t
    for t in ("reader", "reader| ", "legacy"):
        with pytest.raises(Exception, match="bad route"):
            one(spark, codecs.decode_route(F.col("t")), t=t)


def test_clamp_defaults(spark):
    f = lambda v: one(spark, codecs.clamp_or(F.col("v").try_cast("double"), 0.2, 0.9, 0.5), v=v)
    assert [f(v) for v in ("0.05", "1.2", None, "NaN", "0.3")] == [0.2, 0.9, 0.5, 0.5, 0.3]


def test_keywords_and_hits(spark):
    assert one(spark, X.keywords(F.col("t")), t="Sparse sparse lattice, of UNITS") == ["sparse", "lattice", "units"]
    assert len(one(spark, X.tokens(F.col("t")), t="Sparse sparse lattice")) == 3


def test_accepted_correction(spark):
    f = lambda s, c, r=0.25: one(spark, X.accepted_correction(F.col("s"), F.col("c"), F.col("r")), s=s, c=c, r=r)
    assert f("The transforrner works", "The transformer works") == "The transformer works"
    assert f("same", " same ") is None
    assert f("same", "  ") is None
    assert f(r"a \[x\] b", r"a \[y\] b", 1.0) is None
    assert f("abcdefgh", "zzzzzzzz") is None


def test_spans(spark):
    f = lambda t: [(s["kind"], s["text"]) for s in one(spark, X.spans(F.col("t")), t=t)]
    assert f(r"a \[x\] b") == [("TEXT", "a "), ("INLINE_FORMULA", r"\[x\]"), ("TEXT", " b")]
    assert f("a\n\\[x\\]\nb") == [("TEXT", "a\n"), ("DISPLAY_FORMULA", r"\[x\]"), ("TEXT", "\nb")]
    assert f(r"a \[x") == [("TEXT", r"a \[x")]
    assert f("") == []


def test_closing_mark(spark):
    f = lambda t: one(spark, X.closing_mark(F.col("t")), t=t)
    assert [f(t) for t in (r"\[x^2.\]", r"\[x\,\quad\]", r"\[a, \;\]", r"\[\right.\]", r"\[x\]")] == [".", None, ",", None, None]


def test_latex_encoding_and_normal_form(spark):
    assert one(spark, encoded(F.col("t")), t="E = mc² ± ε") == r"\[E = mc^{2} \pm \epsilon\]"
    assert one(spark, encoded(F.col("t")), t=r"\[x^2\]") == r"\[x^2\]"
    assert one(spark, encoded(F.col("t")), t="  ") == ""
    assert one(spark, encoded(F.col("t")), t="50 % of x₁₂") == r"\[50 \% of x_{12}\]"
    assert normalize_text(r"\mathrm { d o g } x _ { 1 }") == "dog x_{1}"
    assert normalize_text(r"\left( \dfrac { a } { b } \right.") == r"(\frac{a}{b}"
    assert normalize_text(r"1 2 . 5 \, \quad x") == "12.5 x"
    assert normalize_text(r"\operatorname* { a r g } \hspace { 1 c m } y") == r"\operatorname*{arg} y"
    assert normalize_text(None) is None and normalize_text("\\") == "\\"


def test_changed_ranges():
    assert changed_ranges("the transforrner works", "the transformer works") == ([[4, 16]], [[4, 15]])
    old, new = changed_ranges("a method", "a robust method")
    assert old == [] and "a robust method"[new[0][0] : new[0][1]].strip() == "robust"
    assert changed_ranges("", "x") == ([], [[0, 1]]) and changed_ranges(None, None) == ([], [])
    a, b = "x " * 400 + "q", "x " * 400 + "r"
    assert changed_ranges(a, b) == ([[800, 801]], [[800, 801]])


def test_boxes(spark):
    b = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("left", "top", "right", "bottom"))])
    assert one(spark, G.iou(b(0, 0, 1, 1), b(0.5, 0, 1.5, 1))) == pytest.approx(1 / 3)
    assert one(spark, G.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0
    assert one(spark, G.containment(b(0, 0, 1, 1), b(0, 0, 2, 2))) == 1
    assert one(spark, G.point_distance2(b(0.2, 0.2, 0.4, 0.4), F.lit(0.1), F.lit(0.3), 100, 100)) == pytest.approx(100)


def test_ink_geometry(spark):
    assert one(spark, G.wrapped_angle(F.lit(3 * math.pi))) == pytest.approx(math.pi)
    assert one(spark, G.wrapped_angle(F.lit(-3.5))) == pytest.approx(-3.5 + 2 * math.pi)
    e = one(spark, G.snapped_end(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.05)))
    assert e["y"] == pytest.approx(0) and e["x"] == pytest.approx(math.hypot(1, 0.05))
    e = one(spark, G.snapped_end(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.3)))
    assert e["y"] == pytest.approx(0.3)
    assert one(spark, G.safe_scale(F.lit(5.0), F.lit(0.0))) == 1
    assert one(spark, G.line_degrees(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0))) == 90
    circle = one(spark, G.ellipse_points(*map(F.lit, (0.5, 0.5, 0.2, 0.0, 0.0, 0.2, 1.0))))
    assert len(circle) == 73 and all(abs(math.hypot(p["x"] - 0.5, p["y"] - 0.5) - 0.2) < 1e-9 for p in circle)
    c = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(x)).alias("y"), F.lit(1.0).alias("pressure")) for x in (0, 1, 2, 3)])
    line = one(spark, G.bezier_points(c))
    assert line[0]["x"] == 0 and line[-1]["x"] == pytest.approx(3) and line[36]["y"] == pytest.approx(1.5)
