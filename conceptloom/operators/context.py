"""Formal contexts: objects x attributes with a binary incidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.functions import masks as M
from conceptloom.scratch import Scratch

# A context's attributes are its columns: their names are plan metadata and are
# the only thing ever brought to the driver.  More than this is refused.
MAX_ATTRIBUTES = 16_384


@dataclass(frozen=True)
class Context:
    """``objects`` has one row per object: ``obj_id``, ``name`` and the words
    ``m0, m1, ...`` of the object's attribute set.  ``attributes`` holds the
    attribute names; the position of a name is its attribute number."""

    objects: DataFrame
    attributes: tuple[str, ...]
    stored_rows: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.objects.sparkSession

    @property
    def n_attributes(self) -> int:
        return len(self.attributes)

    @property
    def k(self) -> int:
        return M.word_count(self.n_attributes)

    @property
    def full(self) -> int:
        """The set of all attributes, as a Python int."""
        return (1 << self.n_attributes) - 1

    def saved(self) -> "Context":
        """The context with its objects and rows written once, for several uses."""
        objects = Scratch(self.spark, "context").save(self.objects, "objects")
        return Context(objects, self.attributes).with_rows()

    def with_rows(self) -> "Context":
        """The context with its distinct rows written once."""
        if self.stored_rows is not None:
            return self
        return replace(self, stored_rows=Scratch(self.spark, "rows").save(self.rows, "rows"))

    def words(self, prefix: str = "m"):
        return M.cols(prefix, self.k)

    @property
    def rows(self) -> DataFrame:
        """Distinct attribute sets ``m*`` with the number ``n`` of objects that
        have them.  Objects with equal rows lie in the same concepts, so all
        operators below work on this much smaller table."""
        if self.stored_rows is not None:
            return self.stored_rows
        return self.objects.groupBy(*M.names("m", self.k)).agg(F.count(F.lit(1)).alias("n"))

    def attributes_df(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(enumerate(self.attributes)), "attr_id int, name string"
        )

    def incidence(self) -> DataFrame:
        """Long form: one row ``(obj_id, attr_id)`` per cross of the context."""
        pairs = M.each_member(self.objects.select("obj_id", *self.words()), self.words(), self.n_attributes, "attr_id")
        return pairs.select("obj_id", "attr_id")

    def support(self) -> DataFrame:
        """Objects per attribute, attributes without objects included."""
        having = M.each_member(self.rows.select(*self.words(), "n"), self.words(), self.n_attributes, "attr_id")
        counts = having.groupBy("attr_id").agg(F.sum("n").alias("n_objects"))
        return self.attributes_df().join(counts, "attr_id", "left").select(
            "attr_id", "name", F.coalesce("n_objects", F.lit(0)).cast("bigint").alias("n_objects")
        )

    def stats(self) -> DataFrame:
        """One row: sizes and fill of the context."""
        size = M.size(self.words())
        cells = F.col("n_objects") * F.lit(self.n_attributes)
        return self.rows.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_objects"),
            F.count(F.lit(1)).alias("n_distinct_rows"),
            F.coalesce(F.sum(size * F.col("n")), F.lit(0)).cast("bigint").alias("n_incidences"),
        ).select(
            "n_objects",
            F.lit(self.n_attributes).cast("bigint").alias("n_attributes"),
            "n_incidences",
            "n_distinct_rows",
            F.when(cells > 0, F.col("n_incidences") / cells).otherwise(F.lit(0.0)).alias("density"),
        )


def from_masks(objects: DataFrame, attributes: Sequence[str]) -> Context:
    """A context whose object table already holds the words ``m*``."""
    return Context(objects, tuple(attributes))


def attribute_names(pairs: DataFrame, attr: str) -> list[str]:
    """Distinct attribute names in ascending order; refuses unbounded sets."""
    found = pairs.select(F.col(attr).cast("string").alias("a")).where("a is not null").distinct()
    got = [r.a for r in found.limit(MAX_ATTRIBUTES + 1).collect()]
    if len(got) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} distinct attributes in column {attr!r}")
    return sorted(got)


def from_pairs(
    pairs: DataFrame,
    obj: str,
    attr: str,
    objects: DataFrame | None = None,
    attributes: Sequence[str] | None = None,
    name: str | None = None,
) -> Context:
    """A context from any table of (object, attribute) pairs.

    ``objects`` (with the key column ``obj`` and, if given, the column ``name``)
    adds the objects that have no attribute; objects of pairs that it lacks stay,
    named by their key.  A pair of an attribute that ``attributes`` lacks raises
    when the context is read.  Objects are told apart by their key, never by their name.
    """
    attributes = list(attributes) if attributes is not None else attribute_names(pairs, attr)
    if len(attributes) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    spark = pairs.sparkSession
    k = M.word_count(len(attributes))
    # bounded by MAX_ATTRIBUTES, so safe to broadcast
    numbers = spark.createDataFrame(list(enumerate(attributes)), "attr_id int, attr_name string")
    known = pairs.select(
        F.col(obj).alias("obj_id"), F.col(attr).cast("string").alias("attr_name")
    ).where(F.col("obj_id").isNotNull())
    unknown = F.raise_error(F.concat(F.lit("pair of an attribute that isn't listed: "), F.col("attr_name"))).cast("int")
    joined = known.join(F.broadcast(numbers), "attr_name", "left").withColumn(
        "attr_id", F.when(F.col("attr_id").isNull() & F.col("attr_name").isNotNull(), unknown).otherwise(F.col("attr_id")))
    sets = joined.groupBy("obj_id").agg(
        *M.rename(M.union_of(F.col("attr_id"), k), "m")
    )
    label = F.col("obj_id").cast("string").alias("name")
    if objects is None:
        return Context(sets.select("obj_id", label, *M.names("m", k)), tuple(attributes))
    keys = objects.select(
        F.col(obj).alias("obj_id"),
        (F.col(name or obj).cast("string")).alias("name"),
        F.lit(True).alias("_listed"),
    )
    filled = keys.join(sets, "obj_id", "full").select(
        "obj_id",
        F.when(F.col("_listed"), F.col("name")).otherwise(F.col("obj_id").cast("string")).alias("name"),
        *[F.coalesce(w, F.lit(0).cast("bigint")).alias(f"m{i}") for i, w in enumerate(M.cols("m", k))],
    )
    return Context(filled, tuple(attributes))


# No longer read: all numbers of values take one plan.
MAX_LOOKUP = 256


def from_columns(
    objects: DataFrame, obj: str, tags: dict[str, str], name: str | None = None
) -> Context:
    """A context from a table of objects with columns of values.

    ``tags`` maps a prefix to a column; each value of the column is an attribute
    ``prefix:value``, a missing value none.  Rows of the same ``obj`` are one object
    with the attributes of all and the least name; rows without ``obj`` stay apart.
    """
    def tag(prefix, column):
        return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))

    values = F.array(*[tag(p, c) for p, c in tags.items()])
    attributes = attribute_names(objects.select(F.explode(values).alias("a")), "a")
    k = M.word_count(len(attributes))
    rows = objects.select(
        F.col(obj).alias("obj_id"), F.col(name or obj).cast("string").alias("name"),
        *[tag(p, c).alias(f"_t{i}") for i, (p, c) in enumerate(tags.items())],
    ).withColumn("_row", F.when(F.col("obj_id").isNull(), F.monotonically_increasing_id()))
    words, zero = M.literal(0, k), F.lit(0).cast("bigint")
    for i in range(len(tags)):
        # bounded by MAX_ATTRIBUTES, so safe to broadcast
        numbers = objects.sparkSession.createDataFrame(list(enumerate(attributes)), f"_n{i} int, _t{i} string")
        rows = rows.join(F.broadcast(numbers), f"_t{i}", "left")
        words = M.union(words, [F.coalesce(w, zero) for w in M.singleton(F.col(f"_n{i}"), k)])
    merged = rows.select("obj_id", "name", "_row", *M.rename(words, "m")).groupBy("obj_id", "_row").agg(
        F.min("name").alias("name"), *[F.bit_or(m).alias(m) for m in M.names("m", k)])
    return Context(merged.select("obj_id", "name", *M.names("m", k)), tuple(attributes))
