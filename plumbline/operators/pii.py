"""Personal data by column header and by value evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.columns import as_text, percentage, unpivoted

#: Labels in order of precedence, and the words that a header equals or contains.
HEADER_RULES = (
    ("email", ("email", "e_mail", "email_address")),
    ("phone", ("phone", "mobile", "telephone", "phone_number")),
    ("person_name", ("first_name", "last_name", "full_name", "person_name", "name")),
    ("date_of_birth", ("dob", "birth_date", "date_of_birth")),
    ("address", ("address", "street", "city", "postal_code", "zip")),
    ("government_id", ("ssn", "aadhaar", "aadhar", "pan", "passport", "national_id", "government_id")),
    ("credit_card", ("card_number", "credit_card", "credit_card_number")),
    ("ip_address", ("ip", "ip_address", "ipv4", "ipv6")),
    ("uuid", ("uuid",)),
)
#: Order in which values alone are tried.
VALUE_ORDER = ("email", "credit_card", "phone", "government_id", "uuid", "ip_address")
#: Shapes of values.
EMAIL = r"(?i)^[^@\s]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+\z"
PHONE = r"^\+?[0-9][0-9 .()-]{7,20}\z"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
IPV4 = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}\z"
PAN = r"^[A-Z]{5}[0-9]{4}[A-Z]\z"


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+\z", "")


def matches(label: str, value: Column) -> Column:
    """Whether a trimmed value has the shape of a label (and passes its check); no value has that of the other labels."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if label == "email":
        return value.rlike(EMAIL)
    if label == "phone":
        return value.rlike(PHONE) & (F.length(digits) >= 10)
    if label == "credit_card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if label == "government_id":
        return F.upper(value).rlike(PAN) | (F.length(digits) == 12)
    if label == "uuid":
        return value.rlike(UUID)
    if label == "ip_address":
        return value.rlike(IPV4) & F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    return F.lit(False)


def header_label(name: Column, match: str = "contains") -> Column:
    """The first label whose words the header holds (``match='token'``: as whole words between underscores); null if none."""
    n = F.regexp_replace(F.lower(trimmed(name)), "[- ]", "_")
    out = F.lit(None).cast("string")
    for label, words in reversed(HEADER_RULES):
        hit = F.lit(False)
        for w in words:
            hit = hit | (n.contains(w) if match == "contains" else F.concat(F.lit("_"), n, F.lit("_")).contains(f"_{w}_"))
        out = F.when(hit, label).otherwise(out)
    return out


def value_ratios(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, label, ratio): count-weighted share of the non-blank values (column_name, value, count) that have a label's shape."""
    v = values.withColumn("v", trimmed(F.col("value"))).where("v <> ''")
    sums = [F.struct(F.lit(label).alias("label"), F.sum(F.when(matches(label, F.col("v")), F.col("count")).otherwise(0)).alias("hits")) for label in VALUE_ORDER]
    n = v.groupBy(*by, "column_name").agg(F.array(*sums).alias("l"), F.sum("count").alias("total")).select(*by, "column_name", "total", F.inline("l"))
    return n.select(*by, "column_name", "label", (percentage(F.col("hits"), F.col("total")) / 100).alias("ratio"))


def column_ratios(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``value_ratios`` over all rows of ``df``: whole values, one scan, and only sums are shuffled."""
    values = unpivoted(df, {f.name: as_text(f.name, f.dataType) for f in df.schema.fields if f.name not in by and (columns is None or f.name in columns)}, by)
    return value_ratios(values.select(*by, "column_name", F.col("v").alias("value"), F.lit(1).alias("count")), by)


def detect(columns: DataFrame, values: DataFrame, by: Sequence[str] = (), match: str = "contains") -> DataFrame:
    """(by, column_name, pii, pii_confidence) of every column; the empty label where there is none.

    A header's label counts 0.75 (0.65 for a person's name in a column just called name), 0.85 and 0.95 from half and
    four fifths of the values on; without one, values alone give 0.80 and 0.90.
    """
    key = [*by, "column_name"]
    ratios = value_ratios(values, by)
    rank = F.array_position(F.array(*[F.lit(x) for x in VALUE_ORDER]), F.col("label"))
    w = Window.partitionBy(*key).orderBy(rank)
    alone = ratios.where("ratio >= 0.5").withColumn("r", F.row_number().over(w)).where("r = 1").select(*key, F.col("label").alias("vl"), F.col("ratio").alias("vr"))
    c = columns.select(*key, header_label(F.col("column_name"), match).alias("hl"))
    own = ratios.select(*key, F.col("label").alias("hl"), F.col("ratio").alias("hr"))
    c = c.join(own, [*key, "hl"], "left").join(alone, key, "left")
    plain = F.when((F.col("hl") == "person_name") & (F.regexp_replace(F.lower(trimmed(F.col("column_name"))), "[- ]", "_") == "name"), 0.65).otherwise(0.75)
    confidence = (
        F.when(F.col("hl").isNotNull(), F.when(F.col("hr") >= 0.8, 0.95).when(F.col("hr") >= 0.5, 0.85).otherwise(plain))
        .when(F.col("vl").isNotNull(), F.when(F.col("vr") >= 0.8, 0.9).otherwise(0.8))
        .otherwise(0.0)
    )
    return c.select(*key, F.coalesce("hl", "vl", F.lit("")).alias("pii"), confidence.alias("pii_confidence"))


def masked(top: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Top values with those of labelled columns masked."""
    key = [*by, "column_name"]
    return top.join(labels.select(*key, "pii"), key, "left").withColumn("value", F.when(F.coalesce("pii", F.lit("")) != "", F.call_function("mask", F.col("value"))).otherwise(F.col("value")))
