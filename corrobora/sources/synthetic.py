"""Candidate tables of any size with planted truth: which records are one person, made row by row from hashes of the row's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYLLABLES = ("ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "zu", "da", "fe")
#: Of 100 groups: one record; two by address; two by number; three by address and then number; two with one number but
#: names that contradict; three strangers behind one address.
SHARES = (("single", 70), ("mail", 18), ("phone", 6), ("chain", 3), ("conflict", 2), ("inbox", 1))


def _word(n: int, *seed: Column) -> Column:
    pick = lambda k: F.element_at(F.array(*[F.lit(s) for s in SYLLABLES]), (F.pmod(F.xxhash64(*seed, F.lit(k)), F.lit(len(SYLLABLES))) + 1).cast("int"))
    return F.initcap(F.concat(*[pick(k) for k in range(n)]))


def people(spark: SparkSession, n: int, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ats, roster, truth) of n groups. ats and roster have the columns of such tables; truth: record_id, person.

    Records of one person share it; strangers and records whose names contradict each other don't.
    """
    i, s = F.col("id"), F.lit(seed)
    dice = F.pmod(F.xxhash64(i, s, F.lit("kind")), F.lit(100))
    kind, upto = F, 0
    for name, share in SHARES:
        upto += share
        kind = kind.when(dice < upto, F.lit(name))
    number = F.lpad(i.cast("string"), 8, "0")
    base = spark.range(n).select(
        number.alias("n"), kind.alias("kind"), _word(3, i, s, F.lit("f")).alias("first"), _word(4, i, s, F.lit("l")).alias("last"),
        F.concat(F.lit("+4915"), F.lpad((i * 7919 % 1_000_000_000).cast("string"), 9, "0")).alias("phone"),
    )
    name, mail = F.concat_ws(" ", "first", "last"), F.lower(F.concat("first", F.lit("."), "n", F.lit("@post.example")))
    stranger = lambda k: F.concat_ws(" ", _word(3, F.col("n"), s, F.lit(f"f{k}")), F.concat(F.lit(k), _word(4, F.col("n"), s, F.lit(f"l{k}"))))
    inbox = F.concat(F.lit("jobs"), "n", F.lit("@agency.example"))
    none = F.lit(None).cast("string")

    def row(table: str, part: int, who: Column, address: Column, phone: Column, person: str) -> Column:
        return F.struct(F.lit(table).alias("table"), F.lit(part).alias("part"), who.alias("name"), address.alias("mail"), phone.alias("phone"), F.concat("n", F.lit(person)).alias("person"))

    rows = (
        F.when(F.col("kind") == "single", F.array(row("ats", 0, name, mail, none, "")))
        .when(F.col("kind") == "mail", F.array(row("ats", 0, name, mail, none, ""), row("roster", 1, F.concat_ws(", ", "last", "first"), F.upper(mail), none, "")))
        .when(F.col("kind") == "phone", F.array(row("ats", 0, name, mail, F.col("phone"), ""), row("roster", 1, name, none, F.col("phone"), "")))
        .when(F.col("kind") == "chain", F.array(row("ats", 0, name, mail, F.col("phone"), ""), row("roster", 1, name, mail, none, ""), row("roster", 2, F.concat_ws(" ", F.substring("first", 1, 1), "last"), none, F.col("phone"), "")))
        .when(F.col("kind") == "conflict", F.array(row("ats", 0, name, mail, F.col("phone"), ""), row("roster", 1, stranger("X"), none, F.col("phone"), "x")))
        .otherwise(F.array(*[row("roster", k, stranger(c), inbox, none, c) for k, c in enumerate("PQR")]))
    )
    r = base.select("n", F.explode(rows).alias("r")).select("n", "r.*")
    kept = r.withColumn("record_id", F.concat(F.lit("gen_"), "table", F.lit("#"), "n", F.lit("-"), F.col("part").cast("string"))).withColumn("source_id", F.concat(F.lit("gen_"), "table"))
    blank = lambda *names: [none.alias(c) for c in names]
    ats = kept.where(F.col("table") == "ats").select(
        "record_id", "source_id", F.col("name").alias("candidatename"), F.col("mail").alias("emailaddress"), F.col("phone").alias("phonenumber"), F.lit(None).cast("double").alias("totalyearsexperience"),
        *blank("email_id", "currentemployer", "designation", "skills", "city", "region", "country", "lastupdated"),
    )
    roster = kept.where(F.col("table") == "roster").select("record_id", "source_id", "name", F.col("mail").alias("email"), "phone", *blank("current_company", "title"))
    return ats, roster, kept.select("record_id", "person")
