"""The queries of the training-data operators: name -> (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import credentials, docpairs, mixing, neighbours, pieces, provenance, residue, syntax, tokens
from lodestrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_lines(table(spark, d, "points"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted_points(table(spark, d, "points"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "points"))


def p2_knn(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.knn(table(spark, d, "points"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.measured_recall(table(spark, d, "points"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_labels(spark, d).where(F.col("label") != "handwritten").select("point_id")


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    return provenance.judge_files(table(spark, d, "points"), table(spark, d, "library_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized_points(*(table(spark, d, t) for t in ("points", "oversized", "project_config")))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized_pieces(*(table(spark, d, t) for t in ("points", "oversized", "project_config")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_symbols(table(spark, d, "points"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, d, "points"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "points"))


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.judge_files(table(spark, d, "points")).dropDuplicates(["point_id"])


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, d, "points"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {}
