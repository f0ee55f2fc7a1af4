"""Every operator as a query over the given tables.

Records are made of documents: the first five words are the title, the rest is
the description.  In matching queries the odd documents are the extracted
records, the even ones the truth, and the language is the project.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reqsift.functions.chunking import chunk_pages
from reqsift.functions.parsing import candidates, lenient_list
from reqsift.functions.rules import NOISE_PHRASES, is_noise, status, tier
from reqsift.functions.text import dashed_text, filled_template, words
from reqsift.operators.dedup import remove_duplicates, word_classes, word_records
from reqsift.operators.enrich import TIMESTAMP, enriched_records, source_context
from reqsift.operators.judging import match_with_judge
from reqsift.operators.match import (
    best_match,
    cross_field_scores,
    first_asked_pairs,
    match_records,
    matched_records,
    missed_records,
    over_created_records,
)
from reqsift.operators.metrics import (
    evaluation_counts,
    label_agreement,
    match_methods,
    quality,
    stage_counts,
    text_volume,
)
from reqsift.operators.ordering import assign_ids
from reqsift.operators.scoring import find_demos, join_responses
from reqsift.operators.simjoin import similar_pairs
from reqsift.operators.training import TrainedClassifier, classify, train_bayes, train_classifier
from reqsift.plans.flows import evaluate, extract, extract_and_deliver, finalise, open_candidates
from reqsift.sources.readers import (
    labelled_examples,
    read_enriched,
    read_page_ranges,
    read_report,
    read_report_rows,
    read_requirements,
    resolve_pages,
    truth_records,
)
from reqsift.sources.sinks import (
    deliver,
    delivery_payloads,
    enriched_documents,
    project_outcomes,
    report_documents,
    requirement_documents,
    save_enriched,
    save_report,
    save_requirements,
    write_documents,
)
from reqsift.workspace import folder, materialize, spread

Query = Callable[[SparkSession, str], DataFrame]

# The texts have no blank lines, so a paragraph is a line here.
LINE = "\n"
# Phrases that occur in the texts, beside the ones looked for by default.
PHRASES = [*NOISE_PHRASES, "license", "all rights reserved"]
VERDICT_MODULUS = 251
# A part size small enough that saved projects have several parts.
PART_ROWS = 20
# A payload size that some records alone exceed.
PART_BYTES = 8192
PROMPT = "Title: {title}\nText: {description}\nKind: [{type}], {title} again; {other} stays"
# A fixed time instead of that of the run.
MOMENT = "2024-05-06 07:08:09.123456"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _joined(listed: Column, begin: int, size: Column) -> Column:
    return F.array_join(F.slice(listed, F.lit(begin), size), " ")


def _title_of(listed: Column) -> Column:
    return _joined(listed, 1, F.lit(5))


def _rest_of(listed: Column) -> Column:
    return _joined(listed, 6, F.greatest(F.size(listed) - 5, F.lit(0)))


def _title(text: Column) -> Column:
    return _title_of(words(text))


def _rest(text: Column) -> Column:
    return _rest_of(words(text))


def records(spark: SparkSession, sf_dir: str, project: Column | None = None) -> DataFrame:
    # The words are split once, in a projection of their own.
    listed = _table(spark, sf_dir, "documents").withColumn("_words", words(F.col("text")))
    return listed.select(
        (F.lit("all") if project is None else project).alias("project"),
        F.col("doc_id").alias("cand_order"),
        _title_of(F.col("_words")).alias("title"),
        _rest_of(F.col("_words")).alias("description"),
        F.when(F.col("doc_id") % 3 == 0, "UI").otherwise("Functional").alias("type"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Odd documents as extracted records, even ones as truth."""
    table = materialize(records(spark, sf_dir, F.col("lang")))
    ext = table.filter(F.col("cand_order") % 2 == 1).select(
        "project",
        F.col("cand_order").alias("ext_order"),
        F.concat(F.lit("E"), F.col("cand_order")).alias("requirement_id"),
        "title",
        "description",
        "type",
    )
    gt = table.filter(F.col("cand_order") % 2 == 0).select(
        "project",
        F.col("cand_order").alias("gt_order"),
        F.concat(F.lit("G"), F.col("cand_order")).alias("id"),
        F.col("title").alias("name"),
        "description",
    )
    return ext, gt


def benchmark_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(
        F.lit("all").alias("project"),
        F.col("item_id").alias("gt_order"),
        F.col("item_id").cast("string").alias("id"),
        _title(F.col("text")).alias("name"),
        _rest(F.col("text")).alias("description"),
    )


def _residue(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % VERDICT_MODULUS


def recorded_verdicts(ext: DataFrame, gt: DataFrame) -> DataFrame:
    """Stands in for a judge's records: yes where the digests of both titles agree."""
    titles = ext.select("project", F.col("title").alias("ext_title")).distinct()
    names = gt.select("project", F.col("name").alias("gt_name")).distinct()
    return (
        titles.withColumn("residue", _residue(F.col("ext_title")))
        .join(names.withColumn("residue", _residue(F.col("gt_name"))), ["project", "residue"])
        .select("project", "ext_title", "gt_name", F.lit(True).alias("is_match"))
    )


def rule_judge(row: dict) -> str:
    """The same rule as ``recorded_verdicts``, as a callable that answers in words."""
    import hashlib

    def residue(text: str) -> int:
        return int(hashlib.md5(text.encode()).hexdigest()[:7], 16) % VERDICT_MODULUS

    return " Yes, same" if residue(row["ext_title"]) == residue(row["gt_name"]) else "no"


def _matched(spark: SparkSession, sf_dir: str, judged: bool = False):
    ext, gt = sides(spark, sf_dir)
    choices = match_records(ext, gt, recorded_verdicts(ext, gt) if judged else None)
    return ext, gt, materialize(matched_records(choices, ext, gt))


# -- text, chunks, parsing, rules ------------------------------------------------------


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(
        F.lit("all").alias("project"), "doc_id", F.lit(1).alias("page_no"), "text"
    )


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_pages(document_pages(spark, sf_dir), separator=LINE)
    return chunks.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "text", "too_short")


def page_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.lit("all").alias("project")
    primary = _table(spark, sf_dir, "documents").select(whole, "doc_id", "text")
    fallback = _table(spark, sf_dir, "conversations").select(
        whole, F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"
    )
    pages, rejects = resolve_pages(primary, fallback)
    return pages.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "text").unionByName(
        rejects.select("doc_id"), allowMissingColumns=True
    )


def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records(spark, sf_dir)
    noise = is_noise(F.col("title"), F.col("description"), PHRASES)
    return found.select(F.col("cand_order").alias("doc_id"), noise.alias("noise"))


def verdict_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    verdict = (
        F.when(F.col("toxic") == 1, " TRUE\n").when(F.col("quality") == 1, "Yes").otherwise("yes, maybe")
    )
    responses = labels.select(F.col("doc_id").alias("cand_order"), verdict.alias("verdict"))
    found = join_responses(records(spark, sf_dir), responses, ["cand_order"])
    noise = is_noise(F.col("title"), F.col("description"), PHRASES)
    return found.select(
        F.col("cand_order").alias("doc_id"),
        status(noise, F.col("verdict"), F.col("error")).alias("status"),
    )


def event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw candidate responses of eight kinds, made of events."""
    kind = F.col("event_id") % 8
    one = F.format_string(
        '{"title": "%s %d", "description": "user %d", "type": "UI"}', "event_type", "event_id", "user_id"
    )
    two = F.format_string('{"title": "second %d", "type": null}', "event_id")
    array = F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]"))
    raw = (
        F.when(kind == 0, array)
        .when(kind == 1, F.concat(F.lit("Here:\n```json\n"), array, F.lit("\n```\nDone.")))
        .when(kind == 2, F.concat(F.lit("```"), array, F.lit("```")))
        .when(kind == 3, one)
        .when(kind == 4, F.concat(array, F.lit(" and more")))
        .when(kind == 5, F.translate(array, '"', "'"))
        .when(kind == 6, F.concat(F.lit("["), one))
        .otherwise(F.lit("  "))
    )
    return _table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


def fence_json_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = event_responses(spark, sf_dir).select(
        "event_id", F.posexplode(candidates(F.col("raw"))).alias("pos", "item")
    )
    return opened.select("event_id", F.col("pos").cast("long").alias("pos"), "item.*")


def json_list_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 6
    raw = (
        F.when(kind == 0, F.format_string('["%s", "user %d"]', "event_type", "user_id"))
        .when(kind == 1, F.format_string('```json\n["fenced %d"]\n```', "event_id"))
        .when(kind == 2, F.format_string('"only %d"', "user_id"))
        .when(kind == 3, F.format_string("  plain %s text ", "event_type"))
        .when(kind == 4, F.format_string('["a"] tail %d', "event_id"))
        .otherwise(F.lit(" \n"))
    )
    opened = _table(spark, sf_dir, "events").select(
        "event_id", F.posexplode(lenient_list(raw)).alias("pos", "value")
    )
    return opened.select("event_id", F.col("pos").cast("long").alias("pos"), "value")


# -- duplicates and numbering ----------------------------------------------------------


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct word sets above the threshold, with the copies behind each."""
    classes = materialize(word_classes(materialize(word_records(records(spark, sf_dir)))))
    copies = classes.select("id", "copies")
    return (
        similar_pairs(classes, ["project"], 0.45)
        .join(copies.toDF("left_id", "left_copies"), "left_id")
        .join(copies.toDF("right_id", "right_copies"), "right_id")
        .select("left_id", "right_id", "left_copies", "right_copies", "similarity")
    )


def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_duplicates(records(spark, sf_dir))
    return kept.select(F.col("cand_order").alias("doc_id"), "title")


def requirement_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDs over all records of a project; one project holds a third of them."""
    project = F.when(F.col("doc_id") % 3 == 0, F.lit("big")).otherwise(F.col("source"))
    numbered = assign_ids(records(spark, sf_dir, project).select("project", "cand_order"))
    return numbered.select("project", F.col("cand_order").alias("doc_id"), "requirement_id")


# -- matching and evaluation -----------------------------------------------------------


def _benchmark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = records(spark, sf_dir).withColumnRenamed("cand_order", "ext_order")
    return cross_field_scores(ext, benchmark_truth(spark, sf_dir))


def cross_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark_scores(spark, sf_dir).select(
        F.col("ext_order").alias("doc_id"), F.col("gt_order").alias("item_id"), "score"
    )


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_match(_benchmark_scores(spark, sf_dir)).select(
        F.col("ext_order").alias("doc_id"), F.col("gt_order").alias("item_id"), "score"
    )


def match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _benchmark_scores(spark, sf_dir)
    return scores.groupBy(tier(F.col("score")).alias("tier")).agg(F.count("*").alias("pairs"))


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[2].drop("ext_order")


def hybrid_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, judged=True)[2].drop("ext_order")


def judge_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid match with verdicts asked from a callable as they are needed."""
    ext, gt = sides(spark, sf_dir)
    choices, _ = match_with_judge(ext, gt, rule_judge)
    return matched_records(choices, ext, gt).drop("ext_order")


def first_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair asked first for each pair of titles, among pairs that are at least borderline."""
    ext = records(spark, sf_dir).withColumnRenamed("cand_order", "ext_order")
    gt = benchmark_truth(spark, sf_dir)
    ext, gt = materialize(ext), materialize(gt)
    # The type serves as the title, so that many records share a key.
    scores = cross_field_scores(ext, gt)
    pairs = scores.join(
        ext.select(
            "ext_order", F.col("type").alias("ext_title"), F.col("description").alias("ext_description")
        ),
        "ext_order",
    ).join(
        gt.select(
            "gt_order", F.col("name").alias("gt_name"), F.col("description").alias("gt_description")
        ),
        "gt_order",
    )
    return first_asked_pairs(pairs).drop("project")


def missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gt, matched = _matched(spark, sf_dir)
    return missed_records(gt, matched).drop("gt_order")


def over_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext, _, matched = _matched(spark, sf_dir)
    return over_created_records(ext, matched).drop("ext_order")


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(evaluation_counts(*_matched(spark, sf_dir)))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_methods(_matched(spark, sf_dir, judged=True)[2])


def _report(spark: SparkSession, sf_dir: str, part_rows: int) -> DataFrame:
    ext, gt, matched = _matched(spark, sf_dir)
    return report_documents(
        ext, gt, matched, missed_records(gt, matched), over_created_records(ext, matched), part_rows
    )


def _flat_report(report: DataFrame) -> DataFrame:
    def ids(name: str, field: str) -> Column:
        return F.array_join(F.transform(F.col(name), lambda item: item[field]), ",")

    return report.select(
        "project",
        "part",
        "parts",
        "metrics.*",
        "counts.*",
        ids("matched", "extracted_id").alias("matched"),
        ids("missed", "gt_id").alias("missed"),
        ids("over_created", "extracted_id").alias("over_created"),
    )


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_report(_report(spark, sf_dir, PART_ROWS))


def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all projects saved, and that of one project read back."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    write_documents(_report(spark, sf_dir, PART_ROWS), path)
    return _flat_report(read_report(spark, path, "en"))


# -- models, enrichment, volumes, delivery ---------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = _table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("is_requirement")
    )
    labels = labelled_examples(examples).select("doc_id", "label")
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").join(labels, "doc_id")


def _rule_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = F.when(F.col("n_chars") > 1000, " YES ").otherwise("no")
    return _labelled(spark, sf_dir).withColumn("predicted", predicted)


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_agreement(_rule_scored(spark, sf_dir))


def demo_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rule(row: dict) -> dict:
        return {"predicted": " YES " if row["n_chars"] > 1000 else "no"}

    examples = _labelled(spark, sf_dir).select("doc_id", "n_chars", "label")
    found = find_demos(examples, rule, ["n_chars"], order="doc_id", per_label=True)
    return found.select("doc_id", "label")


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the labelled documents, then classify all of them."""
    model = train_classifier(_labelled(spark, sf_dir))
    texts = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(model, texts).select("doc_id", "predicted")


def training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document gets an answer, and whether the trained answers agree with the
    labels at least as often as the most frequent label does."""
    labelled = materialize(_labelled(spark, sf_dir))
    model = train_classifier(labelled)
    agrees = classify(model, labelled).select((F.col("predicted") == F.col("label")).cast("int").alias("same"), "label")
    yes = F.avg((F.col("label") == "yes").cast("int"))
    good = agrees.agg((F.avg("same") >= F.greatest(yes, 1 - yes)).alias("as_good_as_majority"))
    texts = _table(spark, sf_dir, "documents").select("doc_id", "text")
    answered = classify(model, texts).select("doc_id", F.col("predicted").isin("yes", "no").alias("answered"))
    # One row on the right.
    return answered.join(F.broadcast(good))


def enrichment_responses(found: DataFrame) -> DataFrame:
    """Recorded enrichment responses, made of the records; every tenth failed."""
    order, title = F.col("cand_order"), F.col("title")
    quoted = F.to_json(F.array(title, F.lit("shown")))
    return found.filter(order % 11 != 0).select(
        "cand_order",
        F.concat(F.lit("As a user, I want "), title).alias("user_story"),
        F.when(order % 2 == 0, quoted)
        .otherwise(F.concat(F.lit("```json\n"), quoted, F.lit("\n```")))
        .alias("acceptance_criteria"),
        F.format_string('[{"step_num": %d, "action": "open"}, "look"]', order).alias("test_steps"),
        F.lit("  ").alias("test_scenarios"),
        F.lit("none known").alias("assumptions"),
        F.lit("[]").alias("ambiguities"),
        F.when(order % 3 == 0, " High ").otherwise("LOW\n").alias("confidence"),
        F.when(order % 10 == 0, "model failed").alias("error"),
    )


def _enriched(spark: SparkSession, sf_dir: str, project: Column | None = None) -> DataFrame:
    found = records(spark, sf_dir, project)
    scored = join_responses(found, enrichment_responses(records(spark, sf_dir)), ["cand_order"])
    return enriched_records(scored, "recorded", F.lit("documents"), F.lit(MOMENT).cast("timestamp"))


def enrich_success_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.col("test_steps")
    return _enriched(spark, sf_dir).select(
        F.col("cand_order").alias("doc_id"),
        "short_title",
        "user_story",
        F.array_join("acceptance_criteria", "|").alias("acceptance_criteria"),
        F.array_join(F.transform(steps, lambda s: s["action"]), "|").alias("step_actions"),
        F.try_element_at(steps, F.lit(1))["step_num"].cast("long").alias("first_step"),
        F.size("test_scenarios").cast("long").alias("scenarios"),
        F.array_join("assumptions", "|").alias("assumptions"),
        F.size("ambiguities").cast("long").alias("ambiguities"),
        "confidence",
        "extraction_model",
        "validation_confirmed",
        "description",
        "is_requirement",
        F.date_format("extraction_timestamp", TIMESTAMP).alias("extraction_timestamp"),
        F.col("metadata.source_file").alias("source_file"),
        F.date_format("metadata.extraction_timestamp", TIMESTAMP).alias("metadata_timestamp"),
        F.col("metadata.validation_confirmed").alias("metadata_confirmed"),
    )


def saved_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched records saved per project and read back."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    save_enriched(_enriched(spark, sf_dir, F.col("source")), path)
    return read_enriched(spark, path).select(
        "project",
        F.col("ext_order").alias("position"),
        "short_title",
        F.array_join("acceptance_criteria", "|").alias("acceptance_criteria"),
        F.date_format("metadata.extraction_timestamp", TIMESTAMP).alias("extraction_timestamp"),
        F.col("metadata.source_file").alias("source_file"),
        "validation_confirmed",
    )


def _conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(
        F.lit("all").alias("project"),
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("page_no"),
        "text",
    )


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_context(_conversation_pages(spark, sf_dir)).drop("project")


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_volume(_conversation_pages(spark, sf_dir)).drop("project")


def counted_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = document_pages(spark, sf_dir)
    chunks = chunk_pages(pages, separator=LINE).withColumn(
        "status", F.when(F.col("too_short"), "skipped").otherwise("kept")
    )
    noise = is_noise(F.lit(""), F.col("text"), PHRASES)
    marked = pages.withColumn("status", F.when(noise, "noise").otherwise("accepted"))
    return stage_counts({"pages": pages, "chunks": chunks, "candidates": marked}).drop("project")


def answer_like_a_receiver(row: dict) -> dict:
    """Receiver that answers by the number its address ends with."""
    number = int(row["url"].rsplit("/", 1)[1])
    count = len(json.loads(row["payload"]))
    kind = number % 5
    if kind == 4:
        raise ConnectionError("connection refused")
    codes = [200, 201, 404, 500]
    bodies = [json.dumps({"stored": count}), "", f"{count} records refused " * 40, "not now"]
    return {"status_code": codes[kind], "body": bodies[kind]}


def delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = enriched_documents(_enriched(spark, sf_dir, F.col("source")), part_rows=PART_ROWS)
    targets = (
        _table(spark, sf_dir, "documents")
        .select(F.col("source").alias("project"))
        .distinct()
        .select(
            "project",
            F.substring("project", 4, 9).cast("long").alias("project_id"),
            F.when(F.col("project") != "src7", "http://receiver").alias("backend_url"),
        )
    )
    return deliver(documents, targets, answer_like_a_receiver)


def delivery_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome per project, however many parts it was sent in."""
    return project_outcomes(delivery(spark, sf_dir))


def save_two_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects saved one group after another, one of them twice, and all read back."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    numbered = materialize(assign_ids(records(spark, sf_dir, F.col("source"))))
    odd = F.substring("project", 4, 9).cast("long") % 2 == 1
    short = numbered.filter(odd).withColumn("title", F.lit("an earlier state"))
    for rows in (short, numbered.filter(~odd), numbered.filter(odd)):
        save_requirements(rows, path)
    return read_requirements(spark, path).select(
        "project", F.col("ext_order").alias("position"), "requirement_id", "title", "type"
    )


def candidate_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with repeated keys, NaN, nulls and a missing type, opened with defaults."""
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.format_string('[{"title": "old", "title": "%s", "x": NaN}]', "event_type"))
        .when(kind == 1, F.format_string('[{"title": null, "description": "user %d"}]', "user_id"))
        .when(kind == 2, F.lit('[{"title": "t", "description": null, "type": null}, {}]'))
        .otherwise(F.concat(F.lit('[{"title": "p", "type": "UI", "description": '), F.to_json(F.array("props")), F.lit("}]")))
    )
    responses = _table(spark, sf_dir, "events").select(
        F.lit("all").alias("project"), F.col("event_id").alias("doc_id"), F.lit(1).alias("page_no"),
        F.lit(0).alias("chunk_no"), raw.alias("raw"),
    )
    opened = open_candidates(responses).filter((F.col("doc_id") % 4 != 3) | (F.col("description") != ""))
    return opened.select(
        F.col("doc_id").alias("event_id"),
        F.col("pos").cast("long").alias("pos"),
        "title",
        F.when(F.col("doc_id") % 4 == 3, "kept").otherwise(F.col("description")).alias("description"),
        "type",
    )


def evaluate_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation with recorded verdicts; report rows saved and read back per project."""
    ext, gt = sides(spark, sf_dir)
    result = evaluate(ext, gt, verdicts=recorded_verdicts(ext, gt))
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    save_report(result.report_rows, path)
    saved = read_report_rows(spark, path, "fr").unionByName(read_report_rows(spark, path, "en"))
    return saved.select(
        "project",
        "section",
        "position",
        "metrics.*",
        "counts.*",
        F.coalesce("matched.extracted_id", "missed.gt_id", "over_created.extracted_id").alias("item_id"),
    )


def ground_truth_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as a sheet: some rows lack an id, a name or a description."""
    item = F.col("item_id")
    sheet = _table(spark, sf_dir, "benchmark").select(
        (item + 1).alias("row_no"),
        F.when(item % 7 != 0, item % 5).alias("code"),
        F.when(item % 6 != 0, _title(F.col("text"))).otherwise("").alias("name"),
        F.when(item % 4 != 0, _rest(F.col("text"))).alias("description"),
    )
    return truth_records(sheet, "row_no", "code", "name", "description", F.lit("all")).drop("project")


def saved_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records numbered, saved as nested documents per project, and read back."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    numbered = assign_ids(records(spark, sf_dir, F.col("source")))
    write_documents(requirement_documents(numbered, part_rows=PART_ROWS), path)
    return read_requirements(spark, path).select("project", "requirement_id", "title", "type")


def first_line_extractor(row: dict) -> dict:
    """Stands in for an extraction model: one candidate per chunk, fenced."""
    found = row["document_text"].split()
    item = {"title": " ".join(found[:5]), "description": " ".join(found[5:]), "type": "UI"}
    return {"raw": "```json\n" + json.dumps([item]) + "\n```"}


def length_classifier(row: dict) -> dict:
    answer = "Yes" if len(row["description"]) % 3 else "no"
    return {"is_requirement": answer, "reason": "length"}


def extract_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(
        document_pages(spark, sf_dir),
        first_line_extractor,
        length_classifier,
        separator=LINE,
        phrases=PHRASES,
    )
    return found.candidates.select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "cand_order", "title", "status"
    )


def extract_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction with a classifier that was fitted on the labelled documents."""
    model = train_bayes(materialize(_labelled(spark, sf_dir).select("text", "label")))
    found = extract(
        document_pages(spark, sf_dir), first_line_extractor, TrainedClassifier(model), separator=LINE, phrases=PHRASES
    )
    return found.candidates.select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "cand_order", "title", "status", "reason"
    )


def extract_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction that finds the answers for a third of its documents in a ledger."""
    ledger = f"{folder(spark)}/{uuid.uuid4().hex}"
    pages = document_pages(spark, sf_dir)

    def run(part: DataFrame) -> DataFrame:
        return extract(
            part, first_line_extractor, length_classifier, separator=LINE, phrases=PHRASES, ledger=ledger
        ).candidates

    run(pages.filter(F.col("doc_id") % 3 == 0))
    return run(pages).select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "cand_order", "title", "status"
    )


def context_enricher(row: dict) -> dict:
    if len(row["title"]) % 9 == 0:
        raise ValueError("no answer")
    return {
        "user_story": row["title"].upper(),
        "acceptance_criteria": json.dumps([str(len(row["source_text"]))]),
        "test_steps": "[]",
        "test_scenarios": "[]",
        "assumptions": "[]",
        "ambiguities": "[]",
        "confidence": "Medium ",
    }


def finalise_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = records(spark, sf_dir).withColumn("doc_id", F.col("cand_order"))
    done = finalise(accepted, document_pages(spark, sf_dir), context_enricher, "recorded")
    return done.enriched.select(
        "doc_id",
        "requirement_id",
        "short_title",
        F.array_join("acceptance_criteria", "|").alias("context_chars"),
        "confidence",
        "validation_confirmed",
    )


def end_lines_extractor(row: dict) -> dict:
    """Stands in for an extraction model: the first and the last line of a chunk."""
    lines = row["document_text"].strip("\n").split("\n")
    items = []
    for line in lines[:1] + lines[1:][-1:]:
        found = line.split()
        items.append({"title": " ".join(found[:5]), "description": " ".join(found[5:])})
    return {"raw": json.dumps(items)}


def extract_deliver_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full run, with two candidates per chunk and one document sent for the project."""
    pages = document_pages(spark, sf_dir).withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id")))
    targets = spark.range(1).select(
        F.lit("all").alias("project"), F.lit(5).cast("long").alias("project_id"), F.lit("http://receiver").alias("backend_url")
    )
    done, outcomes = extract_and_deliver(
        pages, end_lines_extractor, length_classifier, context_enricher, "recorded", targets,
        answer_like_a_receiver, separator=LINE, phrases=PHRASES,
    )
    sent = outcomes.select("project", "success", F.get_json_object("response", "$.stored").cast("long").alias("stored"))
    return done.enriched.join(sent, "project").select(
        "doc_id", "cand_order", "requirement_id", "short_title", F.col("metadata.source_file").alias("source_file"),
        "success", "stored",
    )


def flow_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every stage of a run, counted while it writes its tables."""
    pages = document_pages(spark, sf_dir)
    found = extract(pages, end_lines_extractor, length_classifier, separator=LINE, phrases=PHRASES)
    done = finalise(found.accepted, pages, context_enricher, "recorded", counts=found.counts)
    return done.counts.table(spark)


def parts_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a project in parts whose payload is bounded in bytes."""
    numbered = assign_ids(records(spark, sf_dir, F.col("source")))
    parts = delivery_payloads(requirement_documents(numbered, part_bytes=PART_BYTES))
    items = F.from_json("payload", "array<struct<requirement_id string>>")
    return parts.select(
        "project",
        "part",
        F.octet_length("payload").cast("long").alias("bytes"),
        F.size(items).cast("long").alias("records"),
        F.element_at(items, 1)["requirement_id"].alias("first_id"),
    )


def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's question and a classifier's text for every record; some have no type."""
    found = records(spark, sf_dir)
    values = {
        "title": F.col("title"),
        "description": F.col("description"),
        "type": F.when(F.col("cand_order") % 4 != 0, F.col("type")),
    }
    return found.select(
        F.col("cand_order").alias("doc_id"),
        filled_template(PROMPT, values).alias("prompt"),
        dashed_text(F.col("title"), F.col("description")).alias("shown"),
    )


def count_lines(file) -> int:
    """Lines of a file, read in blocks."""
    found, last = 0, b"\n"
    while block := file.read(1 << 20):
        found, last = found + block.count(b"\n"), block[-1:]
    return found + (last != b"\n")


def lines_between(file, first: int, last: int):
    """Lines ``first`` to ``last`` as pages; lines before them are passed over in blocks."""
    open_line, no = b"", 1
    while block := file.read(1 << 20):
        *whole, open_line = (open_line + block).split(b"\n")
        for line in whole:
            if first <= no <= last:
                yield no, line.decode()
            no += 1
        if no > last:
            return
    if open_line and first <= no <= last:
        yield no, open_line.decode()


def documents_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts saved as files of a language, read back by ranges of lines: each line and how often
    it occurs, with the pages found in all."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    texts.select("lang", "text").write.partitionBy("lang").text(path)
    pages = read_page_ranges(spark, path, count_lines, lines_between, "all", "*.txt", 500)
    lang = F.regexp_extract("path", "lang=([^/]*)/", 1)
    return pages.groupBy(lang.alias("lang"), "text").agg(
        F.count("*").alias("pages"), F.count("error").alias("errors")
    )


def all_queries() -> dict[str, Query]:
    return {
        "chunk_documents": chunk_documents,
        "page_fallback": page_fallback,
        "noise_filter": noise_filter,
        "verdict_split": verdict_split,
        "fence_json_candidates": fence_json_candidates,
        "json_list_lenient": json_list_lenient,
        "jaccard_pairs": jaccard_pairs,
        "greedy_dedup": greedy_dedup,
        "requirement_ids": requirement_ids,
        "cross_field_scores": cross_field,
        "best_match": best,
        "match_tiers": match_tiers,
        "greedy_match": greedy_match,
        "hybrid_match": hybrid_match,
        "judge_match": judge_match,
        "first_asked": first_asked,
        "missed": missed,
        "over_created": over_created,
        "eval_metrics": eval_metrics,
        "match_methods": methods,
        "eval_report": eval_report,
        "report_lookup": report_lookup,
        "label_agreement": agreement,
        "demo_select": demo_select,
        "train_classifier": trained,
        "enrich_success_failure": enrich_success_failure,
        "source_context": context,
        "text_volume": volume,
        "stage_counts": counted_stages,
        "delivery_outcomes": delivery,
        "ground_truth_load": ground_truth_load,
        "saved_requirements": saved_requirements,
        "extract_flow": extract_flow,
        "finalise_flow": finalise_flow,
        "training_quality": training_quality,
        "save_two_projects": save_two_projects,
        "saved_enriched": saved_enriched,
        "delivery_by_project": delivery_by_project,
        "candidate_defaults": candidate_defaults,
        "evaluate_flow": evaluate_flow,
        "extract_deliver_flow": extract_deliver_flow,
        "extract_trained": extract_trained,
        "extract_resumed": extract_resumed,
        "flow_stage_counts": flow_stage_counts,
        "parts_by_bytes": parts_by_bytes,
        "rendered_prompts": rendered_prompts,
        "documents_from_files": documents_from_files,
    }
