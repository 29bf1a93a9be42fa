"""The queries of the ten problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.distinct_terms import log_odds, shared_rare_terms, term_frequencies
from matchloom.llm.groups import consolidate, group_pairs
from matchloom.llm.listings import same_item_groups, same_item_pairs
from matchloom.llm.linking import link_sources
from matchloom.llm.leakage import leak_report, leaked_items
from matchloom.llm.names import spelling_groups
from matchloom.llm.packing import pack_texts
from matchloom.llm.residue import residue_records
from matchloom.llm.split_overlap import cross_split_overlaps, overlap_pairs, overlap_report
from matchloom.llm.splits import assign_splits, key_groups, related_keys
from matchloom.llm.tables import company_entities, unlabelled, unmapped
from matchloom.session import Scratch


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def mapping_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The company mapping with its key and its record."""
    return _read(spark, sf, "companies_master_mapping_seed_0").select(
        F.col("gen_id").cast("string").alias("key"), F.upper(F.trim("external_id")).alias("external_id"), "data_source_id"
    )


def camera_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The camera truth with its key and its record."""
    return _read(spark, sf, "camera_entity_resolution_gt").select(F.upper(F.trim("entity_id")).alias("key"), "spec_id")


MAPPINGS = {
    "companies_master_mapping_seed_0": (mapping_keys, ["external_id", "data_source_id"]),
    "camera_entity_resolution_gt": (camera_keys, ["spec_id"]),
}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return consolidate(_read(spark, sf, "pairwise_matches_preds"), 0.999)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_item_pairs(unlabelled(_read(spark, sf, "camera"), _read(spark, sf, "camera_entity_resolution_gt")))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return same_item_groups(_read(spark, sf, "camera"))


def _companies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    companies = _read(spark, sf, "companies")
    entities = Scratch(spark, "entities").put("e", company_entities(companies, _read(spark, sf, "companies_master_mapping_seed_0")))
    return companies, entities


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    companies, entities = _companies(spark, sf)
    groups = spelling_groups(unmapped(companies, entities).where("data_source_id = '5'"))
    return group_pairs(groups)


def _links(spark: SparkSession, sf: str) -> DataFrame:
    companies, entities = _companies(spark, sf)
    others = companies.where("data_source_id in ('1', '2', '3', '4')")
    truth = entities.where("entity is not null")
    labelled = others.join(truth.select("id").distinct(), "id", "left_semi")
    return link_sources(unmapped(others, entities), labelled, truth)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("lid", "rid")


def p6_links(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).withColumn("confidence", F.round("confidence", 4))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        related_keys(key_groups(keys(spark, sf), "key", record)).select(F.lit(table).alias("map_table"), "key_a", "key_b")
        for table, (keys, record) in MAPPINGS.items()
    ]
    return parts[0].unionByName(parts[1])


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        assign_splits(keys(spark, sf), "key", record).select(F.lit(table).alias("map_table"), "key", "group", "n_rows", "split")
        for table, (keys, record) in MAPPINGS.items()
    ]
    return parts[0].unionByName(parts[1])


def p4_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per table: keys, groups, groups in more than one split, and whether no split is further off its share of the rows than the largest group."""
    x = Scratch(spark, "p4").put("splits", p4_splits(spark, sf))
    share = F.when(F.col("split") == "train", 0.6).otherwise(0.2)
    rows = x.groupBy("map_table", "split").agg(F.sum("n_rows").alias("rows"))
    total = x.groupBy("map_table").agg(F.sum("n_rows").alias("total"))
    groups = x.groupBy("map_table", "group").agg(F.count(F.lit(1)).alias("k"), F.sum("n_rows").alias("size"), F.countDistinct("split").alias("splits"))
    sums = groups.groupBy("map_table").agg(F.sum("k").alias("keys"), F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("splits") > 1, 1)).alias("torn"), F.max("size").alias("largest"))
    off = rows.join(total, "map_table").groupBy("map_table").agg(F.max(F.abs(F.col("rows") - share * F.col("total"))).alias("off"))
    return sums.join(off, "map_table").select("map_table", "keys", "groups", "torn", (F.col("off") <= F.col("largest")).alias("on_target"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_rare_terms(term_frequencies(_read(spark, sf, "companies")))


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    return log_odds(_read(spark, sf, "companies")).withColumn("z", F.round("z", 4))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split_overlaps(
        _read(spark, sf, "camera"), _read(spark, sf, "train"), {"val": _read(spark, sf, "val"), "test": _read(spark, sf, "test")}
    )


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_pairs(_overlaps(spark, sf))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_report(_overlaps(spark, sf), _read(spark, sf, "camera"))


def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_texts(_read(spark, sf, "documents"))


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents placed, containers beyond their capacity, shorter texts divided, texts whose pieces do not join, and whether 95 percent of the space is used."""
    x = Scratch(spark, "p8").put("packed", p8_packing(spark, sf))
    load = x.groupBy("container_id").agg(F.sum("size").alias("load"))
    text = x.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("n"), F.max(F.col("start") + F.col("size")).alias("end"))
    a = load.agg(F.count(F.when(F.col("load") > 2048, 1)).alias("over_capacity"), (F.sum("load") >= 0.95 * 2048 * F.count(F.when(F.col("load") > 0, 1))).alias("well_filled"))
    b = text.agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when((F.col("k") > 1) & (F.col("n") <= 2048), 1)).alias("divided_short"), F.count(F.when(F.col("end") != F.col("n"), 1)).alias("with_gaps")
    )
    return a.crossJoin(b)  # one row each


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return leak_report(p9_found(spark, sf), _read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue_records(_read(spark, sf, "documents")).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_groups, p3_found, p4_found, p4_splits, p4_check, p5_found, p5_scores, p6_found, p6_links, p7_found, p7_report, p8_packing, p8_check, p9_found, p9_report, p10_found)}
