import random

from pyspark.sql import functions as F

from conceptloom.functions import masks as M
from conceptloom.functions import text as X


def test_set_operations_against_python_ints(spark):
    rng = random.Random(1)
    for n in (7, 63, 64, 140):
        k = M.word_count(n)
        data = []
        for _ in range(40):
            a, b = rng.getrandbits(n), rng.getrandbits(n)
            b = rng.choice([b, a & b, a | b, a])
            j = rng.randrange(n)
            data.append((str(a), str(b), j, *M.split_int(a, k), *M.split_int(b, k)))
        schema = "a string, b string, j int, " + ", ".join(f"{p}{i} bigint" for p in "xy" for i in range(k))
        df = spark.createDataFrame(data, schema)
        x, y, j = M.cols("x", k), M.cols("y", k), F.col("j")
        packed = lambda words: F.array(*words)
        rows = df.select(
            "a", "b", "j",
            packed(M.intersect(x, y)).alias("meet"), packed(M.union(x, y)).alias("join"),
            packed(M.difference(x, y)).alias("minus"), packed(M.below(j, k)).alias("below"),
            packed(M.singleton(j, k)).alias("single"), M.size(x).alias("size"),
            M.is_subset(x, y).alias("sub"), M.is_strict_subset(x, y).alias("strict"),
            M.contains(x, j).alias("has"), M.lectic_less(x, y).alias("less"),
            M.lectic_less_at(x, y, j).alias("less_at"), M.agree_below(x, y, j).alias("agree"),
            M.members(x, n).alias("members"), M.to_names(x, [f"a{i}" for i in range(n)]).alias("names"),
            M.to_hex(x).alias("hex"),
        ).collect()
        for r in rows:
            a, b = int(r.a), int(r.b)
            low = (1 << r.j) - 1
            assert M.join_int(r.meet) == a & b and M.join_int(r.join) == a | b
            assert M.join_int(r.minus) == a & ~b and M.join_int(r.below) == low
            assert M.join_int(r.single) == 1 << r.j and r.size == a.bit_count()
            assert r["sub"] == (a & b == a) and r.strict == (a & b == a and a != b)
            assert r.has == bool(a >> r.j & 1) and r.agree == (a & low == b & low)
            diff = a ^ b
            assert r.less == bool(diff and b & (diff & -diff))
            assert r.less_at == bool(not a >> r.j & 1 and b >> r.j & 1 and a & low == b & low)
            assert r.members == [i for i in range(n) if a >> i & 1]
            assert r.names == [f"a{i}" for i in r.members]
            assert M.join_int(int(r.hex[s:s + 16], 16) for s in range(len(r.hex) - 16, -1, -16)) == a


def test_names_to_mask():
    assert M.from_names(["c", "a"], ["a", "b", "c"]) == 5


def test_text_helpers(spark):
    odd = 'a\\b"c{d}e|f<g>'
    df = spark.createDataFrame([(odd,)], "s string")
    row = df.select(X.escape_label(F.col("s")).alias("e"), X.unescape_label(X.escape_label(F.col("s"))).alias("u")).first()
    assert row.e == 'a\\\\b\\"c\\{d\\}e\\|f\\<g\\>' and row.u == odd

    names = ["b10", "B9", "a2x", "a10", "a02", "10", "9", "x"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [r.s for r in df.orderBy(X.natural_key(F.col("s")), "s").collect()]
    assert got == ["9", "10", "a02", "a2x", "a10", "B9", "b10", "x"]
    pinned = [r.s for r in df.orderBy(*X.pinned_natural_key(F.col("s"), "X")).collect()]
    assert pinned[0] == "x"

    sizes = spark.createDataFrame([(None,), (0,), (1023,), (1024,), (1536,), (5 << 20,), (3 << 40,), (3 << 50,)], "n bigint")
    assert [r[0] for r in sizes.select(X.format_bytes(F.col("n"))).collect()] == [
        "NA", "0 B", "1023 B", "1.00 KiB", "1.50 KiB", "5.00 MiB", "3.00 TiB", "3072.00 TiB"
    ]
    times = spark.createDataFrame([("12.5",), ("1:02.50",), ("1:00:01",), ("250 ms",), ("n/a",)], "t string")
    assert [r[0] for r in times.select(X.parse_elapsed(F.col("t"))).collect()] == [12.5, 62.5, 3601.0, 0.25, None]
    assert spark.range(1).select(X.format_elapsed(F.lit(3725.9))).first()[0] == "01:02:05"
    caseless = spark.range(1).select(X.sort_caseless(F.array(*[F.lit(s) for s in ("b", "A", "a", "B", "A")]))).first()[0]
    assert caseless == ["A", "a", "B", "b"]
