"""Every registered query of the log-template library, and its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions import text
from loglattice.operators import catalogue as cat
from loglattice.operators import evaluate, partition, propose, slots
from loglattice.options import Options
from loglattice.plans import views
from loglattice.plans.discover import discover
from loglattice.sources import io
from loglattice.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
PARTS = partition.PART
PROMPT = "Find the template of these lines:\n{}\nTemplate:"


def _lines(s: SparkSession, d: str) -> DataFrame:
    return partition.tokenise(views.customers(s, d))


def _vec(s: SparkSession, d: str) -> DataFrame:
    return partition.s2(partition.vectors(_lines(s, d)))


def _leaves(s: SparkSession, d: str, static: bool = True, **support: float) -> DataFrame:
    return partition.leaves(partition.vectors(_lines(s, d)), static=static, **support)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    found = _leaves(s, d).filter("p1 is not null")
    return found.groupBy(*PARTS, "v1", "v2").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    return partition.assignment(_lines(s, d), io.Saved(s)(_leaves(s, d)))


def _pruned(s: SparkSession, d: str) -> DataFrame:
    """Leaves of the customer lines under both support limits."""
    return partition.leaf_summary(_leaves(s, d, file_support=0.004, partition_support=0.06))


def _proposed(s: SparkSession, d: str) -> DataFrame:
    """Structural proposals of the customer leaves."""
    found = _leaves(s, d).withColumn("leaf", partition.leaf_id())
    first = found.groupBy("leaf").agg(F.min("first").alias("row_nr")).join(views.customers(s, d), "row_nr").select("leaf", F.col("Content").alias("line"))
    return propose.structural(found.select("leaf", "words"), first, ["leaf"]).select("raw_template")


def _kind(line: str) -> str:
    """A stand-in for a model: knows the event log, but for its errors."""
    first = line.split(" ")[0]
    known = {"Click": "Click by user <OID> on widget:<OID> ok", "Order": "Order <OTP> total=<OBA> cents", "View": "View page <SID> by user <OID> now"}
    return known.get(first, line if first == "New" else None)


def _with_proposer(s: SparkSession, d: str):
    """Discovery with a proposer that has no answer for error lines; leaves and then single lines fall back to themselves."""
    return discover(views.logs(s, d).select("row_nr", "LineId", "Content"), Options(chunk_size=400), lambda lists: [(_kind(x[0]), 10, 3) for x in lists])


def _lines_sample(s: SparkSession, d: str) -> DataFrame:
    """Ten random lines of each kind of event; most kinds have few distinct vectors or many lines."""
    lines = views.logs(s, d).withColumn("own", F.split("Content", " ")[0])
    return propose.drawn(lines, "own", lines.groupBy("own").agg(F.count("*").alias("n")), 10).select("own", "row_nr", "Content", F.col("rank").cast("long").alias("rank"))


def _calls(s: SparkSession, d: str) -> DataFrame:
    """A proposer's calls over the event log's lines by length: one length has no answer, which counts as a call."""
    grouped = propose.samples(partition.tokenise(views.logs(s, d)), ["token_len"], 10)
    count = lambda lists: [None if x[0].startswith("New") else ("t", sum(map(len, x)), len(x)) for x in lists]
    return propose.call_totals(propose.ask(grouped, count, 3))


def _by_key(s: SparkSession, d: str) -> DataFrame:
    """Order lines against a catalogue with entries for every customer of an order: more than are sent to workers at once on larger tables."""
    orders = s.read.parquet(f"{d}/orders.parquet")
    lines = orders.select(F.col("o_orderkey").cast("long").alias("row_nr"), F.concat(F.lit("Order "), "o_orderkey", F.lit(" of cust"), "o_custkey", F.lit(": state "), "o_orderstatus").alias("Content"))
    made = [F.concat(F.lit("Order <*> of cust"), "o_custkey", F.lit(f": state {x}")) for x in ("<*>", "F")]
    every = orders.select(F.explode(F.array(*made)).alias("template")).distinct().unionByName(s.range(1).select(F.lit("Order <*> of <*> state <*>").alias("template")))
    return cat.match_by_key(io.spread(lines), cat.entries(every)).select("row_nr", "EventTemplate", text.listed(F.col("ParameterList")).alias("ParameterList"))


def _ordered(s: SparkSession, d: str) -> DataFrame:
    """Reconcile of event lines whose leaves have entries that also match lines of later leaves."""
    lines = views.logs(s, d).select("row_nr", "Content", F.expr(views.OWN).alias("own"))
    rows = [("View page 1 by user <*> now", 1), ("View page <*> by user <*> now", 2), ("View <*> <*> by user <*> now", 3), ("Click by user <*> on widget:<*> ok", 4), ("Error code 7: retry in <*> s", 5)]
    new = cat.entries(s.createDataFrame(rows, "template string, insert_seq long"))
    return cat.match(lines, cat.kept(lines, new, "own", io.Saved(s)), "own").select("row_nr", "EventTemplate")


def _true_catalogue(s: SparkSession, d: str) -> DataFrame:
    return cat.entries(views.logs(s, d).select(F.col("EventTemplate").alias("template")).distinct())


def _matched(s: SparkSession, d: str) -> DataFrame:
    return cat.match(io.spread(views.logs(s, d).select("row_nr", "LineId", "Content")), _true_catalogue(s, d))


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return evaluate.pairs(views.truth(s, d), views.predicted(s, d))


def _stream(s: SparkSession, d: str, step) -> DataFrame:
    """Run a streaming query over the events as a source; returns what it wrote."""
    folder = f"{io.shared_folder(s)}/stream-{uuid.uuid4().hex}"
    schema = s.read.parquet(f"{d}/events.parquet").schema
    source = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    frame = source.select(F.col("event_id").cast("long").alias("row_nr"), F.col("event_id").cast("long").alias("LineId"), F.expr(views.CONTENT).alias("Content"))
    return step(frame, folder)


def _apply_stream(s: SparkSession, d: str) -> DataFrame:
    def step(frame: DataFrame, folder: str) -> DataFrame:
        out = streams.apply_catalogue(frame, _true_catalogue(s, d)).select("LineId", "EventTemplate", "ParameterList")
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
        return s.read.parquet(f"{folder}/out")

    return _stream(s, d, step)


def _discover_stream(s: SparkSession, d: str) -> DataFrame:
    def step(frame: DataFrame, folder: str) -> DataFrame:
        streams.discover_stream(frame, folder, f"{folder}/cp", Options()).awaitTermination()
        return s.read.parquet(f"{folder}/result").drop("v")

    return _stream(s, d, step)


def _raw(s: SparkSession, d: str) -> DataFrame:
    """Raw proposals with all kinds of placeholders, one per customer."""
    t = s.read.parquet(f"{d}/customer.parquet")
    raw = F.concat(F.lit("  <LOI> at {x"), "c_custkey", F.lit("}  <foo>:<SID> #<*># <> "), "c_name", F.lit(' 12.5 /a/b'), "c_custkey", F.lit(' "<*>" end'))
    return t.select(F.col("c_custkey").cast("long").alias("id"), raw.alias("raw"))


def _narrow(lines: list[str]) -> str:
    """A stand-in for a model that goes by what it sees first: lines with an ``a``, if it is shown any."""
    mark = "a" if any(" a-" in x for x in lines) else "b"
    return f"Job {mark}-<SID> ends at step <OID>"


def _second_pass(s: SparkSession, d: str) -> DataFrame:
    """A leaf whose first proposal leaves a tenth of its lines, which another pass partitions and proposes again."""
    found = discover(views.jobs(s, d, False), Options(repool_passes=1, singleton_fallback=False), lambda lists: [_narrow(x) for x in lists])
    return found.matched.select("LineId", "EventTemplate", text.listed(F.col("ParameterList")).alias("ParameterList"))


def _late(lines: list[str]) -> str:
    """A stand-in for a model that names ``Job`` lines, if it is shown any: in the first chunk the others stay noise, in the second they alone are left."""
    return f"{'Job' if any(x.startswith('Job') for x in lines) else 'Run'} <TID>-<SID> ends at step <OID>"


def _recovered(s: SparkSession, d: str) -> DataFrame:
    """Noise of the first chunk that the second chunk's entries explain."""
    found = discover(views.jobs(s, d, True), Options(repool_passes=0, singleton_fallback=False, template_correction=False), lambda lists: [_late(x) for x in lists])
    return found.matched.select("LineId", "EventTemplate", text.listed(F.col("ParameterList")).alias("ParameterList"))


def _inferred(s: SparkSession, d: str) -> DataFrame:
    """Slots of the event log's templates and of two looser ones, from up to 50 lines each."""
    seen = propose.samples(views.logs(s, d), ["EventTemplate"], 50).select(F.col("EventTemplate").alias("template"), "samples", F.array(F.lit("SID"), F.lit("TDA")).alias("slot_types"))
    loose = seen.filter("template like 'View%' or template like 'Click%'").withColumn("template", F.regexp_replace("template", "^(View|Click).*", "$1 <*> user <*>"))
    return slots.infer(seen.unionByName(loose)).select("template", text.listed(F.col("slot_regexes")).alias("slot_regexes"))


def _new_folder(s: SparkSession) -> str:
    return f"{io.shared_folder(s)}/csv-{uuid.uuid4().hex}"


def _csv_documents(s: SparkSession, d: str) -> DataFrame:
    """All documents written as CSV, with quotes and line breaks in their texts, and read back in blocks."""
    path = _new_folder(s)
    t = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    t.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    return io.read_csv(s, path, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _csv_result(s: SparkSession, d: str) -> DataFrame:
    """The result of a run in files, as the evaluation reads it."""
    path = _new_folder(s)
    io.write_result(cat.result(_matched(s, d)), path, "csv")
    return io.read_parsed(s, path).select("LineId", "EventId", "Content", "EventTemplate", "ParameterList")


def _csv_truth(s: SparkSession, d: str) -> DataFrame:
    """Ground truth in files, its templates corrected as they are read: the lines themselves stand for hand-made templates."""
    path = _new_folder(s)
    views.logs(s, d).select("LineId", "Content", F.col("Content").alias("EventTemplate")).write.options(header=True, quote='"', escape='"').csv(path)
    return io.read_truth(s, path, correction=True)


def _messy(s: SparkSession, d: str) -> DataFrame:
    return views.lines(s, d)


def queries() -> dict[str, Query]:
    return {
        "tokenise": lambda s, d: views.logs(s, d).select("row_nr", F.array_join(text.tokens(F.col("Content")), "|").alias("words"), F.size(text.tokens(F.col("Content"))).cast("long").alias("token_len")),
        "token_count_sizes": lambda s, d: partition.sizes(partition.tokenise(views.logs(s, d))).select(F.col("token_len").cast("long").alias("token_len"), "n"),
        "chunk_assignment": lambda s, d: partition.chunked(views.logs(s, d), 5000).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("row_nr").alias("lo"), F.max("row_nr").alias("hi")),
        "row_index": lambda s, d: io.row_index(s.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")),
        "row_index_in_place": lambda s, d: io.row_index(s.read.parquet(f"{d}/orders.parquet")).agg(F.count_distinct("row_nr").alias("numbers"), F.min("row_nr").alias("lo"), F.max("row_nr").alias("hi"), F.count_distinct("o_orderkey").alias("keys")),
        "position_cardinality": lambda s, d: partition.cardinality(partition.vectors(_lines(s, d)), ["chunk_id", "token_len"]).select("chunk_id", F.col("token_len").cast("long").alias("token_len"), F.col("pos").cast("long").alias("pos"), "nu"),
        "split_position": lambda s, d: partition.split_position(partition.cardinality(partition.vectors(_lines(s, d)), ["chunk_id", "token_len"]), ["chunk_id", "token_len"]).select("chunk_id", F.col("s2_pos").cast("long").alias("s2_pos"), "min_nu"),
        "s2_partitions": lambda s, d: partition.s2(partition.vectors(partition.tokenise(views.logs(s, d)))).groupBy("token_len", "s2_value").agg(F.sum("n").alias("n")).select(F.col("token_len").cast("long").alias("token_len"), "s2_value", "n"),
        "partition_goodness": lambda s, d: partition.goodness(_vec(s, d)).select("chunk_id", "s2_value", "goodness"),
        "position_pair": lambda s, d: partition.goodness(_vec(s, d)).select("chunk_id", "s2_value", partition.position_pair(F.col("nus")).alias("pp")).select("chunk_id", "s2_value", F.col("pp.p1").cast("long").alias("p1"), F.col("pp.p2").cast("long").alias("p2")),
        "pair_table": lambda s, d: _pairs(s, d).select("chunk_id", "v1", "v2", "n", "first"),
        "pair_relation": lambda s, d: partition.relations(_pairs(s, d), 0.25).select("chunk_id", "v1", "v2", "c1", "c2", "s3_side"),
        "s3_static_leaves": lambda s, d: _assigned(s, d).select("row_nr", "s2_value", "s3_side", "s3_value"),
        "s3_sequential_leaves": lambda s, d: partition.leaf_summary(_leaves(s, d, static=False)).select("chunk_id", "s2_value", "s3_side", "s3_value", "n", "first"),
        "leaf_summary": lambda s, d: partition.leaf_summary(_leaves(s, d)).select("chunk_id", "s3_side", "s3_value", "n", "first"),
        "support_pruning": lambda s, d: _pruned(s, d).select("chunk_id", "s2_value", "s3_side", "s3_value", "n", "outlier"),
        "outlier_events": lambda s, d: partition.leaf_events(partition.in_order(_pruned(s, d))).select("chunk_id", "s2_value", "s3_side", "s3_value", "n", "event"),
        "leaf_order": lambda s, d: partition.in_order(partition.leaf_summary(_leaves(s, d))).select("leaf_ord", "chunk_id", "s3_side", "s3_value", "trace", "n"),
        "leaf_listing": lambda s, d: partition.leaf_listing(_assigned(s, d), partition.in_order(partition.leaf_summary(_leaves(s, d)))).select("leaf_ord", "row_nr", "Content"),
        "leaf_sample": lambda s, d: propose.sample(_assigned(s, d), ["leaf"], 3).select("row_nr", "s3_value", F.col("rank").cast("long").alias("rank")),
        "truncate_lines": lambda s, d: _messy(s, d).select("doc_id", F.col("place").cast("long").alias("place"), text.truncated(F.col("Content"), 5).alias("head")),
        "prompt_text": lambda s, d: propose.prompts(propose.samples(partition.tokenise(views.logs(s, d)), ["token_len"], 10), PROMPT).select(F.col("token_len").cast("long").alias("token_len"), "prompt"),
        "structural_proposals": _proposed,
        "slot_types": lambda s, d: _raw(s, d).select("id", F.array_join(text.slot_types(F.col("raw")), ",").alias("kinds")),
        "placeholder_normalise": lambda s, d: _raw(s, d).select("id", text.placeholders(F.col("raw")).alias("template")),
        "correct_templates": lambda s, d: views.logs(s, d).select("LineId", text.correct(F.col("Content")).alias("template")),
        "correct_paths": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", text.correct(F.concat(F.lit("GET  "), F.regexp_replace("url", "^[a-z]+://[^/]+", ""), F.lit(" 200"))).alias("template")),
        "compile_patterns": lambda s, d: _true_catalogue(s, d).select("template", "pattern", F.col("literal_len").cast("long").alias("literal_len"), F.col("n_slots").cast("long").alias("n_slots")),
        "infer_slots": _inferred,
        "finish_templates": lambda s, d: _raw(s, d).select("id", text.finish(F.col("raw")).alias("template")),
        "csv_records": _csv_documents,
        "parsed_csv": _csv_result,
        "truth_csv": _csv_truth,
        "repool_pass": _second_pass,
        "final_recovery": _recovered,
        "match_static": lambda s, d: cat.match_by_join(views.logs(s, d), _true_catalogue(s, d)),
        "match_catalogue": lambda s, d: _matched(s, d).select("row_nr", "EventTemplate", text.listed(F.col("ParameterList")).alias("ParameterList")),
        "match_counts": lambda s, d: cat.counts(_matched(s, d)),
        "catalogue_listing": lambda s, d: cat.listing(cat.counted(_true_catalogue(s, d), _matched(s, d))).select("template", "match_frequency"),
        "validate_proposals": lambda s, d: cat.kept(views.logs(s, d).select("Content", F.expr(views.OWN).alias("own")), cat.entries(s.createDataFrame([("View page <*> by user <*> now", 1), ("View <*>", 2), ("Click by user <*> on widget:<*> ok", 4)], "template string, insert_seq long")), "own", io.Saved(s)).select(F.col("insert_seq").alias("own")),
        "ordered_reconcile": _ordered,
        "event_ids": lambda s, d: cat.event_ids(views.logs(s, d)),
        "result_table": lambda s, d: cat.result(_matched(s, d)).select("LineId", "EventId", "Content", "EventTemplate"),
        "noise_rows": lambda s, d: cat.match(views.logs(s, d).select("row_nr", "LineId", "Content"), _true_catalogue(s, d).filter("template not like 'View%'")).filter("EventTemplate is null").select("LineId", "Content"),
        "format_lists": lambda s, d: views.logs(s, d).select("LineId", text.listed(F.filter(text.tokens(F.col("Content")), lambda t: t.rlike("^[0-9]+$"))).alias("numbers")),
        "run_stats": lambda s, d: cat.run_stats(cat.match(views.logs(s, d).select("row_nr", "LineId", "Content"), _true_catalogue(s, d).filter("template not like 'View%'"))),
        "grouping_accuracy": lambda s, d: evaluate.grouping(_metrics(s, d)).select("dataset", F.round("GA", 9).alias("GA"), F.round("FGA", 9).alias("FGA")),
        "parsing_accuracy": lambda s, d: evaluate.parsing(_metrics(s, d)).select("dataset", F.round("PA", 9).alias("PA")),
        "template_metrics": lambda s, d: evaluate.templates(_metrics(s, d)).select("dataset", "n_gt_templates", "n_pred_templates", "exact_template_matches", F.round("template_f1", 9).alias("template_f1")),
        "per_template_pa": lambda s, d: evaluate.per_template(_metrics(s, d)).withColumn("pa", F.round("pa", 9)),
        "worst_templates": lambda s, d: evaluate.per_template(_metrics(s, d)).filter("pa < 1").select("dataset", "gt_template"),
        "dataset_summary": lambda s, d: evaluate.summary(views.truth(s, d), views.predicted(s, d)).select("dataset", *[F.round(c, 9).alias(c) for c in ("GA", "FGA", "PA", "template_precision", "template_recall", "template_f1")], "n_gt_templates", "n_pred_templates", "exact_template_matches"),
        "chunk_size_rule": lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.chunk_size(F.col("o_orderkey") * 1000).alias("chunk_size")),
        "messy_token_counts": lambda s, d: _messy(s, d).select(F.size(text.tokens(F.col("Content"))).cast("long").alias("token_len")).groupBy("token_len").agg(F.count("*").alias("n")),
        "discover_proposer": lambda s, d: _with_proposer(s, d).result.select("LineId", "Content", "EventTemplate", text.listed(F.col("SlotTypes")).alias("SlotTypes")),
        "singleton_fallback": lambda s, d: discover(views.logs(s, d).select("row_nr", "LineId", "Content"), Options(repool_passes=-1)).catalogue.select("template", "match_frequency"),
        "call_totals": lambda s, d: _with_proposer(s, d).stats.select((F.col("llm_calls") > 0).alias("called"), (F.col("input_tokens") / F.col("llm_calls")).alias("sent"), (F.col("output_tokens") / F.col("llm_calls")).alias("back"), "matched", "noise"),
        "leaf_lines_sample": _lines_sample,
        "proposal_calls": _calls,
        "match_by_key": _by_key,
        "discover": flagship,
        "apply_stream": _apply_stream,
        "discover_stream": _discover_stream,
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discover templates of the event log with the structural proposer."""
    found = discover(views.logs(spark, sf_dir).select("row_nr", "LineId", "Content"), Options())
    return found.result.select("LineId", "EventId", "Content", "EventTemplate")


def _duck(c: str) -> str:
    """The correction rules in DuckDB's regex dialect (no lookaround), over the expression ``c``."""
    d, m = r"[\s,!;:=|\"''\[\](){}]", r"[\s,!;:=|\"''\[\](){}.\-+@#$%&]"
    x = rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
    parts = lambda e, k: f"regexp_extract_all({e}, '{k}|{k.replace('[', '[^', 1)}+')"
    x = rf"array_to_string(list_transform({parts(x, d)}, lambda t: CASE WHEN regexp_full_match(t, '(/[^/]+)+') THEN '<*>' ELSE t END), '')"
    x = rf"array_to_string(list_transform({parts(x, m)}, lambda t: CASE WHEN regexp_full_match(t, '\d+') OR (contains(t, '<*>') AND NOT regexp_matches(t, '[\s/]')) THEN '<*>' ELSE t END), '')"
    sub = lambda e, p: rf"regexp_replace({e}, '{p}', '<*>', 'g')"
    x = sub(sub(x, r"<\*>(?:\.<\*>)+"), r"(?:<\*>){2,}")
    bare = lambda e, p: f"array_to_string(list_transform(string_split({e}, ' '), lambda t, i: CASE WHEN i > 1 AND i < len(string_split({e}, ' ')) AND t IN ({p}) THEN '<*>' ELSE t END), ' ')"
    x = bare(x, "'#<*>#', '#<*>'")
    for j in (":", "#", "/", "@", r"\."):
        x = sub(x, rf"<\*>(?:{j}<\*>)+")
    x = bare(x, "'\"<*>\"', '''<*>'''")
    return sub(sub(x, r"(?:<\*>){2,}"), r"<\*>(?: <\*>){4,}")


def _esc(c: str) -> str:
    return rf"regexp_replace({c}, '([^\pL\pN\s])', '\\\1', 'g')"


def oracle_sql() -> dict[str, str]:
    logs, cust, pairs = f"WITH {views.SQL_LOGS}", f"WITH {views.SQL_CUST_PARTS}", f"WITH {views.SQL_PAIRS}"
    words = r"regexp_extract_all(Content, '[^\s=:,]+')"
    raw = """WITH raw AS (SELECT cast(c_custkey AS bigint) AS id, concat('  <LOI> at {x', c_custkey, '}  <foo>:<SID> #<*># <> ', c_name, ' 12.5 /a/b', c_custkey, ' "<*>" end') AS raw FROM customer)"""
    tags = "OID|LOI|OBN|TID|SID|TDA|CRS|OBA|STC|OTP"
    holes = f"replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(raw, '<({tags})>', '<*>', 'g'), '<*>', chr(1)), '\\{{[^}}]+\\}}', chr(1), 'g'), '<[^>]+>', chr(1), 'g'), '<[^>]*>', chr(1), 'g'), chr(1), '<*>')"
    true_cat = "cat AS (SELECT DISTINCT EventTemplate AS template FROM logs)"
    pat = lambda c, flags="s": f"concat('(?{flags})^', array_to_string(list_transform(string_split({c}, '<*>'), lambda p: {_esc('p')}), '(\\S+)'), '\\z')"
    ids = "ids AS (SELECT EventTemplate, concat('E', row_number() OVER (ORDER BY EventTemplate)) AS EventId FROM (SELECT DISTINCT EventTemplate FROM logs))"
    lines = "lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS Content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
    good = "g0 AS (SELECT dataset, gt, pred, n, count(*) OVER (PARTITION BY dataset, pred) AS gts FROM pairs), g1 AS (SELECT dataset, gt, sum(n) AS n, (gt IS NOT NULL AND count(*) = 1 AND bool_and(pred IS NOT NULL AND gts = 1)) AS good FROM g0 GROUP BY dataset, gt)"
    ga = "sum(CASE WHEN good THEN n ELSE 0 END) / sum(n)"
    per = "per AS (SELECT dataset, gt AS gt_template, string_agg(DISTINCT pred, ', ' ORDER BY pred) AS pred_templates, cast(sum(n) AS bigint) AS total, cast(sum(CASE WHEN ok THEN n ELSE 0 END) AS bigint) AS correct FROM pairs GROUP BY ALL)"
    kinds = "k AS (SELECT dataset, gt AS t, 1 AS g, 0 AS p FROM pairs UNION SELECT dataset, pred, 0, 1 FROM pairs WHERE pred IS NOT NULL), k1 AS (SELECT dataset, t, max(g) AS g, max(p) AS p FROM k GROUP BY ALL), k2 AS (SELECT dataset, cast(sum(g) AS bigint) AS n_gt_templates, cast(sum(p) AS bigint) AS n_pred_templates, cast(sum(g*p) AS bigint) AS exact_template_matches FROM k1 GROUP BY ALL)"
    params = "CASE WHEN EventTemplate LIKE 'New%' THEN NULL WHEN EventTemplate LIKE 'Order%' THEN concat('[''', split_part(split_part(Content, 'Order ', 2), ' total', 1), ''', ''', split_part(split_part(Content, 'total=', 2), ' ', 1), ''']') ELSE concat('[''', array_to_string(regexp_extract_all(Content, '[0-9]+'), ''', '''), ''']') END"
    n_gt = "(SELECT dataset AS d2, count(DISTINCT gt) AS n_gt FROM pairs GROUP BY ALL)"
    return {
        "tokenise": f"{logs} SELECT row_nr, array_to_string({words}, '|') AS words, cast(len({words}) AS bigint) AS token_len FROM logs",
        "token_count_sizes": f"{logs} SELECT cast(len({words}) AS bigint) AS token_len, count(*) AS n FROM logs GROUP BY ALL",
        "chunk_assignment": f"{logs} SELECT cast(floor(row_nr / 5000) AS bigint) AS chunk_id, count(*) AS n, min(row_nr) AS lo, max(row_nr) AS hi FROM logs GROUP BY ALL",
        "row_index": "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_nr FROM orders",
        "row_index_in_place": "SELECT count(*) AS numbers, cast(0 AS bigint) AS lo, count(*) - 1 AS hi, count(DISTINCT o_orderkey) AS keys FROM orders",
        "position_cardinality": f"{cust} SELECT chunk_id, token_len, pos, nu FROM cards",
        "split_position": f"{cust} SELECT chunk_id, s2_pos, min_nu FROM split",
        "s2_partitions": f"{logs}, t AS (SELECT {words} AS w FROM logs), c AS (SELECT n, p, count(DISTINCT k) AS nu FROM (SELECT len(w) AS n, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS k FROM t) GROUP BY ALL), s AS (SELECT n, min(nu) AS m, arg_min(p, nu * 1000 + p) AS p FROM c GROUP BY ALL) SELECT cast(len(w) AS bigint) AS token_len, CASE WHEN m > 1 THEN w[p + 1] END AS s2_value, count(*) AS n FROM t JOIN s ON len(w) = s.n GROUP BY ALL",
        "partition_goodness": f"{cust} SELECT chunk_id, s2_value, goodness FROM good",
        "position_pair": f"{cust} SELECT chunk_id, s2_value, p1, p2 FROM pp",
        "pair_table": f'{cust} SELECT chunk_id, v1, v2, n, "first" FROM pt',
        "pair_relation": f"{cust} SELECT chunk_id, v1, v2, c1, c2, s3_side FROM rel",
        "s3_static_leaves": f"{cust} SELECT row_nr, s2_value, s3_side, s3_value FROM leaf",
        "s3_sequential_leaves": f'WITH RECURSIVE {views.SQL_CUST_PARTS}, {views.SQL_SEQUENCE}, {views.sql_leaf("leaf2", "walk")} SELECT chunk_id, s2_value, s3_side, s3_value, count(*) AS n, min(row_nr) AS "first" FROM leaf2 GROUP BY chunk_id, token_len, s2_pos, s2_value, s3_side, s3_value',
        "leaf_summary": f'{cust} SELECT chunk_id, s3_side, s3_value, count(*) AS n, min(row_nr) AS "first" FROM leaf GROUP BY chunk_id, token_len, s2_pos, s2_value, s3_side, s3_value',
        "support_pruning": f"{cust}, {views.SQL_PRUNED} SELECT chunk_id, s2_value, s3_side, s3_value, n, outlier FROM pruned",
        "outlier_events": f"{cust}, {views.SQL_PRUNED}, {views.SQL_EVENTS} SELECT chunk_id, s2_value, s3_side, s3_value, n, event FROM events_",
        "leaf_order": f"{cust}, {views.SQL_ORDER} SELECT leaf_ord, chunk_id, s3_side, s3_value, trace, n FROM ordered",
        "leaf_listing": f"{cust}, {views.SQL_ORDER} SELECT leaf_ord, row_nr, Content FROM ordered o JOIN (SELECT leaf.*, Content FROM leaf JOIN cust USING (row_nr)) l ON o.chunk_id = l.chunk_id AND o.token_len = l.token_len AND o.s2_pos IS NOT DISTINCT FROM l.s2_pos AND o.s2_value IS NOT DISTINCT FROM l.s2_value AND o.s3_side IS NOT DISTINCT FROM l.s3_side AND o.s3_value IS NOT DISTINCT FROM l.s3_value",
        "leaf_sample": f"{cust}, u AS (SELECT row_nr, s3_value, row_number() OVER (PARTITION BY chunk_id, token_len, s2_pos, s2_value, s3_side, s3_value ORDER BY row_nr) AS rank FROM leaf) SELECT * FROM u WHERE rank <= 3",
        "truncate_lines": f"WITH {lines} SELECT doc_id, place, array_to_string(string_split(Content, ' ')[1:5], ' ') AS head FROM lines",
        "prompt_text": f"{logs}, u AS (SELECT len({words}) AS token_len, Content, row_number() OVER (PARTITION BY len({words}) ORDER BY row_nr) AS r FROM logs) SELECT cast(token_len AS bigint) AS token_len, concat('Find the template of these lines:', chr(10), string_agg(Content, chr(10) ORDER BY Content), chr(10), 'Template:') AS prompt FROM u WHERE r <= 10 GROUP BY token_len",
        "slot_types": f"{raw} SELECT id, array_to_string(regexp_extract_all(raw, '<({tags})>', 1), ',') AS kinds FROM raw",
        "placeholder_normalise": f"{raw} SELECT id, {holes} AS template FROM raw",
        "correct_templates": f"{logs} SELECT LineId, {_duck('Content')} AS template FROM logs",
        "correct_paths": f"WITH u AS (SELECT page_id, concat('GET  ', regexp_replace(url, '^[a-z]+://[^/]+', ''), ' 200') AS c FROM pages) SELECT page_id, {_duck('c')} AS template FROM u",
        "compile_patterns": f"{logs}, {true_cat} SELECT template, {pat('template', 'sU')} AS pattern, cast(length(replace(template, '<*>', '')) AS bigint) AS literal_len, cast(len(string_split(template, '<*>')) - 1 AS bigint) AS n_slots FROM cat",
        "infer_slots": f"{logs}, {views.SQL_SLOTS} SELECT template, slot_regexes FROM slots",
        "finish_templates": f"{raw}, h AS (SELECT id, {holes} AS h FROM raw) SELECT id, trim({_duck('h')}) AS template FROM h",
        "csv_records": "SELECT cast(doc_id AS bigint) AS doc_id, coalesce(text, '') AS text FROM documents",
        "parsed_csv": f"{logs}, {ids} SELECT LineId, EventId, Content, EventTemplate, {params} AS ParameterList FROM logs JOIN ids USING (EventTemplate)",
        "truth_csv": f"{logs} SELECT LineId, Content, {_duck('Content')} AS EventTemplate FROM logs",
        "repool_pass": f"WITH l AS (SELECT cast(event_id AS bigint) AS LineId, {views.JOB} AS c, user_id FROM events) SELECT LineId, concat(c[1:6], '<*> ends at step <*>') AS EventTemplate, concat('[''', LineId, ''', ''', user_id, ''']') AS ParameterList FROM l",
        "final_recovery": f"WITH l AS (SELECT cast(event_id AS bigint) AS LineId, {views.JOB_CHUNKS} AS c, user_id FROM events) SELECT LineId, concat(c[1:4], '<*>-<*> ends at step <*>') AS EventTemplate, concat('[''', c[5:5], ''', ''', LineId, ''', ''', user_id, ''']') AS ParameterList FROM l",
        "match_static": f"{logs}, {true_cat}, hit AS (SELECT row_nr, template, row_number() OVER (PARTITION BY row_nr ORDER BY length(replace(template, '<*>', '')) DESC, len(string_split(template, '<*>')) DESC, template) AS r FROM logs JOIN cat ON regexp_matches(Content, {pat('template')})) SELECT row_nr, template AS EventTemplate FROM hit WHERE r = 1",
        "match_catalogue": f"{logs} SELECT row_nr, EventTemplate, {params} AS ParameterList FROM logs",
        "match_counts": f"{logs} SELECT EventTemplate AS template, count(*) AS match_frequency FROM logs GROUP BY ALL",
        "catalogue_listing": f"{logs} SELECT EventTemplate AS template, count(*) AS match_frequency FROM logs GROUP BY ALL",
        "validate_proposals": f"{logs}, o AS (SELECT DISTINCT {views.OWN} AS own, Content FROM logs), h AS (SELECT own, Content FROM o WHERE (own = 1 AND regexp_full_match(Content, 'View page \\S+ by user \\S+ now')) OR (own = 4 AND regexp_full_match(Content, 'Click by user \\S+ on widget:\\S+ ok'))) SELECT DISTINCT cast(own AS bigint) AS own FROM h",
        "ordered_reconcile": f"{logs} SELECT row_nr, CASE WHEN Content LIKE 'Click%' THEN 'Click by user <*> on widget:<*> ok' WHEN Content NOT LIKE 'View%' THEN NULL WHEN Content LIKE 'View page 1 by%' THEN 'View page 1 by user <*> now' WHEN {views.OWN} = 1 THEN NULL ELSE 'View page <*> by user <*> now' END AS EventTemplate FROM logs",
        "event_ids": f"{logs}, {ids} SELECT EventTemplate, EventId FROM ids",
        "result_table": f"{logs}, {ids} SELECT LineId, EventId, Content, EventTemplate FROM logs JOIN ids USING (EventTemplate)",
        "noise_rows": f"{logs} SELECT LineId, Content FROM logs WHERE EventTemplate LIKE 'View%'",
        "format_lists": f"{logs}, u AS (SELECT LineId, list_filter({words}, lambda t: regexp_full_match(t, '[0-9]+')) AS l FROM logs) SELECT LineId, CASE WHEN len(l) > 0 THEN concat('[''', array_to_string(l, ''', '''), ''']') END AS numbers FROM u",
        "run_stats": f"{logs} SELECT count(*) FILTER (EventTemplate NOT LIKE 'View%') AS matched, count(*) FILTER (EventTemplate LIKE 'View%') AS noise FROM logs",
        "grouping_accuracy": f"{pairs}, {good}, g2 AS (SELECT dataset, {ga} AS ga, sum(CASE WHEN good THEN 1 ELSE 0 END) AS k FROM g1 GROUP BY ALL), q AS (SELECT dataset, count(DISTINCT pred) + max(CASE WHEN pred IS NULL THEN 1 ELSE 0 END) AS np FROM pairs GROUP BY ALL) SELECT dataset, round(ga, 9) AS GA, round(CASE WHEN k = 0 THEN 0.0 ELSE 2 * (k / np) * (k / n_gt) / (k / np + k / n_gt) END, 9) AS FGA FROM g2 JOIN q USING (dataset) JOIN {n_gt} ON dataset = d2",
        "parsing_accuracy": f"{pairs} SELECT dataset, round(sum(CASE WHEN ok THEN n ELSE 0 END) / sum(n), 9) AS PA FROM pairs GROUP BY ALL",
        "template_metrics": f"{pairs}, {kinds} SELECT *, round(CASE WHEN exact_template_matches = 0 THEN 0.0 ELSE 2.0 * exact_template_matches / (n_gt_templates + n_pred_templates) END, 9) AS template_f1 FROM k2",
        "per_template_pa": f"{pairs}, {per} SELECT dataset, gt_template, coalesce(pred_templates, '') AS pred_templates, total, correct, round(correct / total, 9) AS pa FROM per",
        "worst_templates": f"{pairs}, {per} SELECT dataset, gt_template FROM per WHERE correct < total",
        "dataset_summary": f"{pairs}, {good}, {kinds}, g2 AS (SELECT dataset, {ga} AS ga, sum(CASE WHEN good THEN 1 ELSE 0 END) AS k FROM g1 GROUP BY ALL), q AS (SELECT dataset, count(DISTINCT pred) + max(CASE WHEN pred IS NULL THEN 1 ELSE 0 END) AS np FROM pairs GROUP BY ALL), p AS (SELECT dataset, sum(CASE WHEN ok THEN n ELSE 0 END) / sum(n) AS pa FROM pairs GROUP BY ALL) SELECT dataset, round(ga, 9) AS GA, round(CASE WHEN k = 0 THEN 0.0 ELSE 2 * (k / np) * (k / n_gt) / (k / np + k / n_gt) END, 9) AS FGA, round(pa, 9) AS PA, round(exact_template_matches / n_pred_templates, 9) AS template_precision, round(exact_template_matches / n_gt_templates, 9) AS template_recall, round(CASE WHEN exact_template_matches = 0 THEN 0.0 ELSE 2.0 * exact_template_matches / (n_gt_templates + n_pred_templates) END, 9) AS template_f1, n_gt_templates, n_pred_templates, exact_template_matches FROM g2 JOIN q USING (dataset) JOIN p USING (dataset) JOIN k2 USING (dataset) JOIN {n_gt} ON dataset = d2",
        "chunk_size_rule": "WITH u AS (SELECT o_orderkey, greatest(least(o_orderkey * 1000.0, 16e6), 20e3) AS n FROM orders) SELECT o_orderkey, cast(round_even((3000 + (log10(n) - log10(20e3)) / (log10(16e6) - log10(20e3)) * 37000) / 500, 0) * 500 AS bigint) AS chunk_size FROM u",
        "messy_token_counts": f"WITH {lines}, u AS (SELECT regexp_replace(Content, '[' || chr(11) || chr(133) || chr(160) || chr(5760) || chr(8192) || '-' || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || ']', ' ', 'g') AS Content FROM lines) SELECT cast(len({words}) AS bigint) AS token_len, count(*) AS n FROM u GROUP BY ALL",
        "structural_proposals": f"{cust} SELECT string_agg(tok, ' ' ORDER BY pos) AS raw_template FROM (SELECT leaf.chunk_id, leaf.token_len, leaf.s2_pos, leaf.s2_value, leaf.s3_side, leaf.s3_value, pos, CASE WHEN count(DISTINCT token) = 1 THEN min(token) ELSE '<*>' END AS tok FROM leaf JOIN (SELECT row_nr, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM tok) USING (row_nr) GROUP BY ALL) GROUP BY chunk_id, token_len, s2_pos, s2_value, s3_side, s3_value",
        "discover_proposer": f"{logs} SELECT LineId, Content, CASE WHEN Content LIKE 'Error%' THEN regexp_replace(regexp_replace(Content, 'code [0-9]+', 'code <*>'), 'in [0-9]+', 'in <*>') ELSE EventTemplate END AS EventTemplate, CASE WHEN Content LIKE 'Click%' THEN '[''OID'', ''OID'']' WHEN Content LIKE 'Order%' THEN '[''OTP'', ''OBA'']' WHEN Content LIKE 'View%' THEN '[''SID'', ''OID'']' END AS SlotTypes FROM logs",
        "singleton_fallback": f"{logs} SELECT {_duck('Content')} AS template, count(*) AS match_frequency FROM logs GROUP BY ALL",
        "call_totals": f"{logs} SELECT true AS called, 10.0::DOUBLE AS sent, 3.0::DOUBLE AS back, count(*) AS matched, cast(0 AS bigint) AS noise FROM logs",
        "leaf_lines_sample": f"{logs}, u AS (SELECT split_part(Content, ' ', 1) AS own, row_nr, Content, row_number() OVER (PARTITION BY split_part(Content, ' ', 1) ORDER BY md5(concat('42:', row_nr)), row_nr) AS rank FROM logs) SELECT * FROM u WHERE rank <= 10",
        "proposal_calls": f"{logs}, u AS (SELECT len({words}) AS token_len, Content, row_number() OVER (PARTITION BY len({words}) ORDER BY row_nr) AS r FROM logs), g AS (SELECT token_len, min(Content) LIKE 'New%' AS failed, sum(length(Content)) AS sent, count(*) AS back FROM u WHERE r <= 10 GROUP BY token_len) SELECT count(*) AS llm_calls, cast(coalesce(sum(sent) FILTER (NOT failed), 0) AS bigint) AS input_tokens, cast(coalesce(sum(back) FILTER (NOT failed), 0) AS bigint) AS output_tokens FROM g",
        "match_by_key": "SELECT cast(o_orderkey AS bigint) AS row_nr, concat('Order <*> of cust', o_custkey, CASE WHEN o_orderstatus = 'F' THEN ': state F' ELSE ': state <*>' END) AS EventTemplate, concat('[''', o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE concat(''', ''', o_orderstatus) END, ''']') AS ParameterList FROM orders",
        "discover": f"{logs}, u AS (SELECT LineId, Content, EventTemplate FROM logs), i AS (SELECT EventTemplate, concat('E', row_number() OVER (ORDER BY EventTemplate)) AS EventId FROM (SELECT DISTINCT EventTemplate FROM u)) SELECT LineId, EventId, Content, EventTemplate FROM u JOIN i USING (EventTemplate)",
    }

