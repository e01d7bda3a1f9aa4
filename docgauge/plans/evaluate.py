"""Full evaluation of a corpus: one row in, one nested evaluation row out.

The plan is a chain of projections over one scan. The type-specific metrics
are a single CASE on the metric family, so each row computes only its own
family and the corpus is read once. The only joins are optional side tables
keyed by document (semantic scores, OCR means); without them nothing is
shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge import rules
from docgauge.functions import scoring as S
from docgauge.functions import values as V
from docgauge.functions.text import bind, extension, normalize_text
from docgauge.operators import (
    classify, contract, core, core_known, general, insights, invoice, mail, markup, records, social, tabular,
)

FAMILIES_ON_RAW = ("tabular", "markup", "email")


def prepare(documents: DataFrame) -> DataFrame:
    """Fill in the optional input columns and resolve type and family.

    Required: doc_id, filename, text. Optional: raw (file content before
    extraction), document_type (supplied type), fields (field map), line_items,
    semantic (struct of six scores), reasoning (map of metric to text),
    lang_share (share of English lines, by a detector of your own), supplied_summary, supplied_risk,
    supplied_recommendations (used unless empty), created_at, field_<name> (the fields as columns, see ``core_known``).
    """
    have = set(documents.columns)
    col = lambda name, default: F.col(name) if name in have else default
    no_reasoning = F.create_map().cast("map<string,string>")
    base = documents.select(
        "doc_id",
        "filename",
        extension(F.col("filename")).alias("ext"),
        normalize_text(F.col("text")).alias("text"),
        col("raw", F.col("text")).alias("raw"),
        col("document_type", F.lit("unknown")).alias("supplied_type"),
        F.coalesce(col("fields", V.no_fields()), V.no_fields()).alias("fields"),
        col("line_items", V.no_line_items()).alias("line_items"),
        col("semantic", F.lit(None).cast("struct<completeness:double>")).alias("semantic"),
        F.coalesce(col("reasoning", no_reasoning), no_reasoning).alias("reasoning"),
        col("mean_conf", F.lit(None).cast("double")).alias("mean_conf"),
        col("blocks", F.lit(0)).alias("blocks"),
        *([F.col("lang_share").cast("double").alias("lang_share")] if "lang_share" in have else []),
        col("created_at", F.lit(None).cast("timestamp_ntz")).alias("created_at"),
        col("supplied_summary", F.lit(None).cast("string")).alias("supplied_summary"),
        col("supplied_risk", F.lit(None).cast("string")).alias("supplied_risk"),
        col("supplied_recommendations", F.lit(None).cast("array<string>")).alias("supplied_recommendations"),
        *[F.col(c) for c in documents.columns if c.startswith("field_")],
    )
    # lower-cased once here for every rule that searches the text
    lowered = base.withColumn("low", F.lower("text"))
    typed = lowered.withColumn("document_type", classify.resolve_type(
        F.col("supplied_type"), F.col("text"), F.col("filename"), F.col("low")))
    routed = typed.withColumn("family", classify.metric_family(F.col("ext"), F.col("document_type"))).withColumn(
        "payload", F.when(F.col("ext") == ".json", V.parse_json(F.col("raw")))
    )
    return records.with_type_checks(routed, "payload", "raw")


def type_metrics(binding: str = "raw", detect_language: bool = True, families=None, given_share: bool = False) -> Column:
    """Metrics of the row's family, as an array of metric records.

    The share of English lines is the column ``lang_share`` if it is given, else it
    comes from function words.

    ``families`` limits the plan to the families a corpus is known to hold; a
    row of any other family stops the job.
    """
    text, low = F.col("text"), F.col("low")
    share = F.col("lang_share") if given_share else social.english_share(text)
    source = lambda family: F.col("raw") if binding == "raw" and family in FAMILIES_ON_RAW else text
    by_family = {
        "contract": lambda: contract.metrics(F.col("fields"), text, low),
        "invoice": lambda: invoice.metrics(
            F.col("fields"), F.col("line_items"), F.col("ext"), F.col("mean_conf"), F.col("blocks")),
        "json": lambda: records.metrics(F.col("payload"), F.col("type_checks")),
        "social_media": lambda: social.metrics(text, share if detect_language else None, low),
        "tabular": lambda: tabular.metrics(source("tabular")),
        "markup": lambda: markup.metrics(source("markup")),
        "email": lambda: mail.metrics(source("email")),
        "general": lambda: general.metrics(text, low),
    }
    unexpected = F.raise_error(F.concat(F.lit("unexpected metric family "), F.col("family")))
    out = unexpected.cast("array<struct<name:string,score:double,description:string,status:string,details:string,document_type:string>>")
    for family, metrics in by_family.items():
        if families is None or family in families:
            out = F.when(F.col("family") == family, metrics()).otherwise(out)
    return out


def _blended(name: str, missing_semantic: str, supplied: set[str]) -> Column:
    score = F.col(f"core_{name}.score")
    semantic = F.col(f"semantic.{name}") if name in supplied else F.lit(None).cast("double")
    if missing_semantic == "zero":
        return S.blend_scores(score, F.coalesce(semantic, F.lit(0.0)))
    return F.when(semantic.isNull(), score).otherwise(S.blend_scores(score, semantic))


def evaluate(documents: DataFrame, as_of: str, binding: str = "raw", missing_semantic: str = "skip",
             detect_language: bool = True, families=None, field_names=None, issue_parts=None) -> DataFrame:
    """Evaluate every document.

    ``as_of`` is the moment dates are judged from. ``binding`` selects what the
    tabular, markup and e-mail metrics look at: the file content (``raw``) or
    the extracted text (``text``). ``missing_semantic`` says whether a missing
    semantic score counts as 0 (``zero``) or leaves the score as it is (``skip``).
    ``families`` may name the only metric families that occur, ``field_names`` the only fields, and
    with these ``issue_parts`` the fields of the issues to build (``severity`` is always needed).
    """
    docs = prepare(documents)
    supplied = set(docs.schema["semantic"].dataType.names) if "semantic" in documents.columns else set()
    if field_names is None:
        core_scored = docs.withColumns(core.all_core(
            F.col("fields"), F.col("line_items"), F.col("text"), F.col("document_type"), F.lit(as_of), F.col("low")))
    else:
        core_scored = core_known.with_core(docs, F.lit(as_of), field_names, issue_parts)
    scored = core_scored.withColumnsRenamed({n: f"core_{n}" for n in rules.CORE_METRICS}).withColumn(
        "type_specific_metrics", type_metrics(binding, detect_language, families, "lang_share" in documents.columns)
    )
    blended = scored.withColumns({f"score_{n}": _blended(n, missing_semantic, supplied) for n in rules.CORE_METRICS})
    scores = {n: F.col(f"score_{n}") for n in rules.CORE_METRICS}
    issues_of = {n: F.col(f"core_{n}.issues") for n in rules.CORE_METRICS}
    # an array of columns, not a lambda: Spark compiles it, and whoever reads one part computes only that
    metric_rows = F.array(*[F.struct(
        F.lit(n.capitalize()).alias("name"), scores[n].alias("score"), F.lit(rules.CORE_DESCRIPTIONS[n]).alias("description"),
        F.col(f"message_{n}").alias("status_message"),
        S.status_of(scores[n]).alias("status"), F.lit(rules.CORE_WEIGHTS[n]).alias("weight"),
        F.col(f"reason_{n}").alias("reasoning"),
    ) for n in rules.CORE_METRICS])
    built = blended.select(
        "doc_id", "filename", "document_type", "family", "created_at", "type_specific_metrics",
        "supplied_summary", "supplied_risk", "supplied_recommendations",
        *scores.values(),
        *[S.status_message(F.lit(n), scores[n], issues_of[n]).alias(f"message_{n}") for n in rules.CORE_METRICS],
        # why a service gave its score; empty without a reply
        *[F.coalesce(F.col("reasoning")[n], F.lit("")).alias(f"reason_{n}") for n in rules.CORE_METRICS],
        F.concat(*issues_of.values()).alias("issues"),
        S.overall_score(scores).alias("overall_score"),
        S.type_score(F.col("type_specific_metrics")).alias("type_specific_score"),
        insights.in_row(scores, F.col("type_specific_metrics"), F.col("document_type")).alias("insights"),
    )
    mean = sum((F.col(f"score_{n}") for n in rules.CORE_METRICS[1:]), F.col(f"score_{rules.CORE_METRICS[0]}")) / 6
    top = F.transform(F.slice("insights", 1, 3), lambda i: i["issue"])
    return built.select(
        "doc_id", "filename", "document_type", "family", "overall_score",
        S.status_of(F.col("overall_score")).alias("overall_status"),
        metric_rows.alias("metrics"), "type_specific_metrics", "type_specific_score", "issues", "insights",
        insights.prefer_supplied(F.col("supplied_summary"), insights.executive_summary(
            F.col("document_type"), mean, top, F.size("insights"), F.size("issues"))).alias("executive_summary"),
        insights.prefer_supplied(F.col("supplied_risk"), insights.risk_summary(F.col("insights"), F.size("issues"))).alias("risk_summary"),
        F.when(F.size("supplied_recommendations") > 0, F.col("supplied_recommendations"))
        .otherwise(insights.recommendations(F.col("insights"))).alias("recommendations"),
        "created_at",
    )


def parse_semantic_payload(payload: Column) -> Column:
    """Semantic scores from a service reply: code fences removed, JSON parsed.

    NULL when the reply is not JSON or a score is outside 0 to 100; a missing
    score is 0.
    """
    from docgauge import schemas

    bare = F.regexp_replace(
        F.regexp_replace(payload, r"(?U)^\s*(?:```json)?(?:```)?", ""), r"(?U)(?:```)?\s*$", ""
    )
    names = schemas.SEMANTIC_SCORES.names

    def checked(b: Column) -> Column:
        given = {n: F.coalesce(b["p"]["semantic_evaluation"][n], F.lit(0.0)) for n in names}
        in_range = None
        for c in given.values():
            in_range = c.between(0, 100) if in_range is None else in_range & c.between(0, 100)
        return F.when(b["ok"] & in_range, F.struct(
            F.coalesce(b["p"]["document_type"], F.lit("")).alias("document_type"),
            V.variant_fields(b["p"]["fields"]).alias("fields"),
            V.variant_line_items(b["p"]["fields"]).alias("line_items"),
            F.struct(*[c.alias(n) for n, c in given.items()]).alias("semantic"),
            b["p"]["metric_reasoning"].alias("reasoning"),
            b["p"]["executive_summary"].alias("executive_summary"),
            b["p"]["risk_summary"].alias("risk_summary"),
            b["p"]["recommendations"].alias("recommendations"),
        ))

    def parsed(bare: Column) -> Column:
        is_json_object = V.parse_json(bare).isNotNull() & bare.rlike(r"\A\s*\{")
        return F.struct(F.from_json(bare, schemas.SEMANTIC_PAYLOAD).alias("p"), is_json_object.alias("ok"))

    # bound: the fences are looked for once
    return bind(bind(bare, parsed), checked)


def with_semantic(documents: DataFrame, replies: DataFrame) -> DataFrame:
    """Left-join parsed replies (doc_id, reply): type, fields, line items, scores, reasons and texts.

    A reply that cannot be read counts as none: such documents have no fields and get
    the fallback texts. Texts that a reply leaves out stay empty, so that the local
    ones are used. Of several replies for a document the last in text order counts, so
    each document stays one row. Columns of the documents with these names are replaced.
    """
    # parsed above the join: below it, the optimizer would derive filters from the whole parse
    one_each = replies.groupBy("doc_id").agg(F.max("reply").alias("_reply"))
    parsed = documents.join(one_each, "doc_id", "left").withColumn(
        "p", parse_semantic_payload(F.col("_reply")))
    given = F.col("p").isNotNull()
    text = lambda name, fallback: F.when(given, F.coalesce(F.col(f"p.{name}"), F.lit(""))).otherwise(fallback)
    kind = F.coalesce(F.nullif(F.col("p.document_type"), F.lit("")), F.lit("unknown"))
    added = {
        "document_type": kind, "fields": F.col("p.fields"), "line_items": F.col("p.line_items"), "semantic": F.col("p.semantic"),
        "reasoning": F.col("p.reasoning"),
        "supplied_summary": text("executive_summary", rules.FALLBACK_SUMMARY),
        "supplied_risk": text("risk_summary", rules.FALLBACK_RISK),
        "supplied_recommendations": F.when(given, F.col("p.recommendations")).otherwise(F.array(*map(F.lit, rules.FALLBACK_RECOMMENDATIONS))),
    }
    return parsed.select(
        *[F.col(c) for c in documents.columns if c not in added], *[c.alias(n) for n, c in added.items()])
