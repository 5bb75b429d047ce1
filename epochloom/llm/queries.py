"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochloom.llm.leaks import find_leaks
from epochloom.llm.packing import Capacity, pack_documents
from epochloom.llm.residue import find_residue
from epochloom.llm.runs import collapse_runs
from epochloom.llm.splits import assign_groups, components, spelled_number
from epochloom.runtime import spill, table


def _persons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of ``ml`` with their number, and (number, person) over records and confirmed links."""
    records = table(spark, sf_dir, "ml").withColumn("number", spelled_number(F.col("pid")))
    links = table(spark, sf_dir, "pid_links").where(F.lower(F.trim("status")) == "confirmed")
    ends = links.select(F.concat(F.lit("l"), F.col("link_id").cast("string")).alias("record"), F.explode(F.array("pid_a", "pid_b")).alias("entity"))
    own = records.select("number").distinct().select(F.concat(F.lit("n"), F.col("number").cast("string")).alias("record"), F.col("number").alias("entity"))
    return records, components(ends.unionByName(own)).select(F.col("entity").alias("number"), F.col("part").alias("pid_min"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons whose records lie in two or more assigned folds, with each such fold."""
    records, persons = _persons(spark, sf_dir)
    folds = records.where("fold is not null and fold <> -1").groupBy("number", "fold").agg(F.count("*").alias("n"))
    pairs = folds.join(persons, "number").groupBy("pid_min", "fold").agg(F.sum("n").alias("n"))
    return pairs.withColumn("k", F.count("*").over(Window.partitionBy("pid_min"))).where("k >= 2").select("pid_min", "fold")


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of ``ml`` with its person and its split, 80/10/10, stratified by cohort."""
    records, persons = _persons(spark, sf_dir)
    rows = records.join(spill(persons), "number").select("row_id", "pid_min", F.lower(F.trim("cohort")).alias("cohort"))
    rows = spill(rows)
    return rows.join(assign_groups(rows, group="pid_min", label="cohort"), "pid_min").select("row_id", "pid_min", "split")


def p2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the splits, per cohort: every record has a split, every person one, and no share is off by more than a hundredth (or ten records)."""
    done = spill(p2_splits(spark, sf_dir))
    cohorts = table(spark, sf_dir, "ml").select("row_id", F.coalesce(F.lower(F.trim("cohort")), F.lit("none")).alias("cohort"), spelled_number(F.col("pid")).isNotNull().alias("named"))
    rows = cohorts.join(done, "row_id", "left")
    persons = done.groupBy("pid_min").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("divided_persons"))
    n = F.count("split")
    near = lambda name, share: F.abs(F.count_if(F.col("split") == name) - share * n) <= F.greatest(n / 100, F.lit(10))
    per = rows.groupBy("cohort").agg(F.count("*").alias("records"), F.count_if(F.col("named") & F.col("split").isNull()).alias("without_split"), (near("train", 0.8) & near("validation", 0.1) & near("test", 0.1)).alias("balanced"))
    return per.crossJoin(persons)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(table(spark, sf_dir, "hyp_epochs"), source="pid", time="hyp_time_col", value="hyp_sleep_bin", received="received_at", key="row_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest runs of two or more equal epochs."""
    return _runs(spark, sf_dir).where("n_epochs >= 2").select("pid", "run_start_s", "n_epochs", "duration_s")


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, single epochs too, with its level."""
    return _runs(spark, sf_dir).select("pid", "run_start_s", "run_end_s", F.col("hyp_sleep_bin").alias("level"), "n_epochs", "duration_s")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeches with a passage of an evaluation item, and the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), key="doc_id", text="text")


def _capacity(spark: SparkSession, sf_dir: str, window: str) -> Capacity:
    """Tokens of one of the context windows, a document per 64 tokens, and three quarters of the attention of a single full text."""
    tokens = table(spark, sf_dir, "context_windows").where(F.col("window_name") == window).select("capacity_tokens").first()["capacity_tokens"]
    return Capacity(tokens, documents=max(1, tokens // 64), attention=3 * tokens**2 // 4)


def p6_containers(spark: SparkSession, sf_dir: str, window: str = "base") -> DataFrame:
    """Every non-blank text or piece with its container, for the capacity of one of the context windows."""
    return pack_documents(table(spark, sf_dir, "documents"), _capacity(spark, sf_dir, window), key="doc_id", text="text")


def p6_check(spark: SparkSession, sf_dir: str, window: str = "base") -> DataFrame:
    """What must hold of the containers: every non-blank text once and whole, cut only if longer than a container, no capacity exceeded."""
    cap = _capacity(spark, sf_dir, window)
    packed = spill(p6_containers(spark, sf_dir, window))
    texts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("token_end").alias("end"), F.count("*").alias("k"), F.count_distinct("token_start").alias("starts"))
    held = packed.groupBy("shard", "container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("a"))
    broken = (F.col("n") != F.col("end")) | (F.col("k") != F.col("starts")) | (F.col("k") != F.ceil(F.col("end") / cap.tokens))
    return texts.agg(F.count("*").alias("texts"), F.count_if(broken).alias("broken_texts")).crossJoin(
        held.agg(F.count_if(F.col("n") > cap.tokens).alias("over_tokens"), F.count_if(F.col("k") > cap.documents).alias("over_documents"), F.count_if((F.col("a") > cap.attention) & (F.col("k") > 1)).alias("over_attention"))
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are or hold residue of templates, filler, error pages or script notices."""
    return find_residue(table(spark, sf_dir, "documents"), key="doc_id", text="text")


_RUNS_SQL = """
with last_sent as (
  select pid, hyp_time_col, arg_max(coalesce(hyp_sleep_bin, -99), (received_at, row_id)) as bin
  from hyp_epochs where pid is not null and hyp_time_col is not null group by pid, hyp_time_col),
levels as (
  select pid, epoch(hyp_time_col)::bigint as t, case when bin > -50 and not isnan(bin) then floor(bin * 2 + 0.5) / 2 end as v from last_sent),
flagged as (
  select *, case when v = lag(v) over w and t - lag(t) over w <= 300 then 0 else 1 end as f from levels window w as (partition by pid order by t)),
numbered as (select *, sum(f) over (partition by pid order by t rows unbounded preceding) as g from flagged),
runs as (
  select pid, min(t) as run_start_s, max(t) as run_end_s, any_value(v) as level, count(*)::int as n_epochs, max(t) - min(t) + 30 as duration_s
  from numbered where v is not null group by pid, g)
"""

QUERIES = {"p2_found": p2_found, "p2_splits": p2_splits, "p2_check": p2_check, "p5_found": p5_found, "p5_runs": p5_runs, "p6_containers": p6_containers, "p6_check": p6_check, "p7_found": p7_found, "p8_found": p8_found}
ORACLE_SQL = {
    "p2_found": """
with recursive r as (select try_cast(regexp_extract(pid, '^\\D*?0*(\\d{1,18})(?:\\.0*)?\\D*$', 1) as bigint) as number, fold from ml),
links as (select pid_a as a, pid_b as b from pid_links where lower(trim(status)) = 'confirmed'),
edges as (select a, b from links union select b, a from links),
reach(n, m) as (select number, number from r where number is not null union select a, a from edges
  union select reach.n, edges.b from reach join edges on reach.m = edges.a),
person as (select n, min(m) as pid_min from reach group by n),
folds as (select distinct pid_min, fold from r join person on r.number = person.n where fold is not null and fold <> -1)
select pid_min, fold from folds qualify count(*) over (partition by pid_min) >= 2""",
    "p2_check": """
select coalesce(lower(trim(cohort)), 'none') as cohort, count(*) as records, 0::bigint as without_split, true as balanced, 0::bigint as divided_persons
from ml group by 1""",
    "p6_check": r"""
select count(*) as texts, 0::bigint as broken_texts, 0::bigint as over_tokens, 0::bigint as over_documents, 0::bigint as over_attention
from documents where regexp_matches(text, '[^\s\x{0B}\x{85}\p{Z}]')""",
    "p5_found": _RUNS_SQL + "select pid, run_start_s, n_epochs, duration_s from runs where n_epochs >= 2",
    "p5_runs": _RUNS_SQL + "select pid, run_start_s, run_end_s, level, n_epochs, duration_s from runs",
}
