"""Synthetic clinical tables (demographics, vital signs, laboratory, adverse events, analysis sets) for fixtures.

Each value is a function of the seed and the row's number, so tables of any size come from ``spark.range``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Codes and units of the generated tables.
VITALS = [("SYSBP", "mmHg", 120.0, 15.0), ("DIABP", "mmHg", 80.0, 10.0), ("PULSE", "beats/min", 72.0, 10.0), ("TEMP", "C", 36.8, 0.4), ("WEIGHT", "kg", 75.0, 15.0)]
LABS = [("HGB", "g/dL", 14.0, 1.5), ("CREAT", "mg/dL", 0.9, 0.2), ("ALT", "U/L", 25.0, 10.0), ("AST", "U/L", 24.0, 9.0), ("WBC", "10^9/L", 7.0, 2.0)]
TERMS = "HEADACHE NAUSEA VOMITING DIZZINESS FATIGUE".split()
SEXES, RACES, ARMS = ["M", "F"], ["WHITE", "BLACK OR AFRICAN AMERICAN", "ASIAN", "OTHER"], ["Placebo", "Low Dose", "High Dose"]


def pick(values: list[str], *salt: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(*salt), F.lit(len(values))) + 1).cast("int"))


def uniform(*salt: Column | str) -> Column:
    return F.pmod(F.xxhash64(*salt), F.lit(1_000_003)) / 1_000_003.0


def subjects(spark: SparkSession, study: str, n: int, seed: int = 42) -> DataFrame:
    i, s = F.col("id") + 1, F.lit(seed)
    number = F.lpad(i.cast("string"), 3, "0")
    age = (18 + F.floor(uniform(s, F.lit("age"), i) * 63)).cast("int")
    return spark.range(n).select(
        F.lit(study).alias("STUDYID"), F.concat(F.lit(study), number).alias("USUBJID"), number.alias("SUBJID"), pick(["001", "002", "003"], s, F.lit("site"), i).alias("SITEID"),
        age.alias("AGE"), F.lit("YEARS").alias("AGEU"), pick(SEXES, s, F.lit("sex"), i).alias("SEX"), pick(RACES, s, F.lit("race"), i).alias("RACE"), pick(ARMS, s, F.lit("arm"), i).alias("TRT01P"),
    )


def findings(dm: DataFrame, tests: list[tuple[str, str, float, float]], prefix: str, visits: int, seed: int = 42) -> DataFrame:
    """Vital signs (``VS``) or laboratory results (``LB``): every test at every visit."""
    t = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(u).alias("unit"), F.lit(m).alias("mean"), F.lit(d).alias("spread")) for c, u, m, d in tests])).alias("t")
    rows = dm.select("STUDYID", "USUBJID", t).select("*", F.explode(F.sequence(F.lit(1), F.lit(visits))).alias("VISITNUM"))
    value = F.round(F.col("t.mean") + F.col("t.spread") * (2 * uniform(F.lit(seed), "USUBJID", "t.code", "VISITNUM") - 1), 2)
    return rows.select("STUDYID", "USUBJID", F.col("t.code").alias(f"{prefix}TESTCD"), value.alias(f"{prefix}STRESN"), F.col("t.unit").alias(f"{prefix}STRESU"), "VISITNUM", F.concat(F.lit("Visit "), F.col("VISITNUM").cast("string")).alias("VISIT"))


def adverse_events(dm: DataFrame, seed: int = 42) -> DataFrame:
    """One to three events for about three subjects in ten."""
    n = F.when(uniform(F.lit(seed), F.lit("ae"), "USUBJID") < 0.3, 1 + F.floor(uniform(F.lit(seed), F.lit("n"), "USUBJID") * 3)).otherwise(0).cast("int")
    rows = dm.select("STUDYID", "USUBJID", n.alias("n")).where("n > 0").select("STUDYID", "USUBJID", F.explode(F.sequence(F.lit(1), "n")).alias("AESEQ"))
    return rows.select("*", pick(TERMS, F.lit(seed), "USUBJID", "AESEQ").alias("AETERM"), pick(["MILD", "MODERATE", "SEVERE"], F.lit(seed), F.lit("sev"), "USUBJID", "AESEQ").alias("AESEV"))


def baseline_changes(rows: DataFrame, by: list[str], visit: str, value: str) -> DataFrame:
    """``rows`` with BASE (value of the first visit), CHG, PCHG (0 at the first visit or on a zero base) and ABLFL."""
    w = W.partitionBy(*by).orderBy(visit)
    first = F.row_number().over(w) == 1
    base = F.first(value).over(w)
    out = rows.withColumns({"BASE": base, "_first": first})
    change = F.when(F.col("_first"), 0.0).otherwise(F.round(F.col(value) - F.col("BASE"), 6))
    percent = F.when(F.col("_first") | (F.col("BASE") == 0), 0.0).otherwise(F.round(100 * (F.col(value) - F.col("BASE")) / F.col("BASE"), 6))
    return out.withColumns({"CHG": change, "PCHG": percent, "ABLFL": F.when(F.col("_first"), "Y").otherwise("")}).drop("_first")


def subject_level(dm: DataFrame, seed: int = 42, days: int = 84) -> DataFrame:
    """ADSL: a row a subject, with the treatment taken, its first and last day, baseline measures and population flags."""
    part = lambda name: uniform(F.lit(seed), F.lit(name), "USUBJID")
    start = F.date_add(F.lit("2023-06-01").cast("date"), F.floor(100 * part("start")).cast("int"))
    height, weight = F.round(150 + 40 * part("height"), 1), F.round(50 + 50 * part("weight"), 1)
    flag = lambda name: pick(["Y", "N"], F.lit(seed), F.lit(name), "USUBJID")
    return dm.select(
        "*", F.col("TRT01P").alias("TRT01A"), start.alias("TRTSDT"), F.date_add(start, days).alias("TRTEDT"), F.lit(days).alias("TRTDURD"),
        pick(["HISPANIC OR LATINO", "NOT HISPANIC OR LATINO"], F.lit(seed), F.lit("ethnic"), "USUBJID").alias("ETHNIC"), height.alias("HEIGHTBL"), weight.alias("WEIGHTBL"),
        F.round(weight / (height / 100) ** 2, 1).alias("BMIBL"), F.lit("Y").alias("SAFFL"), F.lit("Y").alias("ITTFL"), flag("eff").alias("EFFFL"), flag("comp").alias("COMPFL"),
    )


def laboratory_analysis(lb: DataFrame, adsl: DataFrame) -> DataFrame:
    """ADLB: laboratory results by parameter and visit with their baseline, changes and the subject's treatment."""
    rows = lb.select("STUDYID", "USUBJID", F.col("LBTESTCD").alias("PARAMCD"), F.lit("LABORATORY").alias("PARCAT1"), F.col("LBSTRESN").alias("AVAL"), F.col("LBSTRESU").alias("AVALU"), F.col("VISITNUM").alias("AVISITNUM"), F.col("VISIT").alias("AVISIT"))
    return baseline_changes(rows, ["STUDYID", "USUBJID", "PARAMCD"], "AVISITNUM", "AVAL").join(adsl.select("USUBJID", "TRT01P", "TRT01A", "TRTSDT"), "USUBJID").withColumn(
        "ADT", F.expr("date_add(TRTSDT, 14 * (AVISITNUM - 1))")
    ).drop("TRTSDT")


def carried_forward(rows: DataFrame, by: list[str], visit: str, value: str) -> DataFrame:
    """The last known value at each visit."""
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(visit).rowsBetween(W.unboundedPreceding, 0)))


def study_text(spark: SparkSession, study: str, kind: str = "Protocol") -> DataFrame:
    """(title, content) of a protocol or an analysis plan in Markdown."""
    body = f"# {kind} {study}\n\n## Objectives\n\nThe study assesses efficacy and safety of the treatment.\n\n## Design\n\n- Randomised\n- Double blind\n\n## Endpoints\n\n1. Change from baseline\n2. Adverse events\n"
    return spark.createDataFrame([(f"{study}_{kind}", body)], "title string, content string")
