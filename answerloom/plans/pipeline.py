"""The whole analysis: answers, clauses, vectors, themes, assignment, ratings, result.

Each stage has a key made of its parents' keys, its part of the settings and a
version number, and its table is kept under that key; a run with equal keys
reads it. Settings that only matter for the result (thresholds of evidence)
enter no earlier key.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import similarities
from ..operators import assign, backends, discover, ingest, quality, rating, segment, sentiment, spelling, suggest
from ..sources.config import Config, canonical
from ..sources.state import FrozenGroups, Stages, VectorCache, load_json, save_json

#: A stage's number goes up when what it computes changes.
VERSIONS = {"ingest": 1, "segment": 1, "embed": 1, "themes": 1, "assign": 1, "overall": 1, "aspects": 1}
PARENTS = {"ingest": (), "segment": ("ingest",), "embed": ("segment",), "themes": ("embed",), "assign": ("themes",), "overall": ("ingest",), "aspects": ("assign",), "result": ("aspects", "overall")}
SECTIONS = {"ingest": ("input",), "segment": ("segment",), "embed": ("embed",), "themes": ("themes", "assign.min_sim"), "assign": ("assign",), "overall": ("overall",), "aspects": ("absa.model",)}


def rules_from(kind, section: dict | None):
    """A rules dataclass with what a section sets; keys it does not know are left out."""
    names = {f.name for f in fields(kind)}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in (section or {}).items() if k in names}
    return kind(**values)


def stage_keys(config: Config, source: str, models: dict[str, str]) -> dict[str, str]:
    keys: dict[str, str] = {}
    for stage, parents in PARENTS.items():
        parts = [*(keys[p] for p in parents), str(VERSIONS.get(stage, 0)), config.section_hash(*SECTIONS.get(stage, ())), models.get(stage, "")]
        if not parents:
            parts.append(source)
        keys[stage] = hashlib.sha1("|".join(parts).encode()).hexdigest()[:12]
    return keys


@dataclass
class Run:
    answers: DataFrame | None = None
    clauses: DataFrame | None = None
    vectors: DataFrame | None = None
    themes: dict[str, list[assign.Theme]] = field(default_factory=dict)
    assigned: DataFrame | None = None
    dropped_keywords: list = field(default_factory=list)
    overall: DataFrame | None = None
    aspects: DataFrame | None = None
    ratings: DataFrame | None = None
    detail: DataFrame | None = None
    result: DataFrame | None = None
    report: dict = field(default_factory=dict)
    cached: list[str] = field(default_factory=list)


def theme_record(t: assign.Theme) -> dict:
    return {"name": t.name, "centre": np.asarray(t.centre, float).tolist(), "keywords": list(t.keywords), "assign_keywords": list(t.assign_keywords), "curated_keywords": list(t.curated_keywords), "match_name": t.match_name, "general": t.general, "sub_centres": [np.asarray(c, float).tolist() for c in t.sub_centres], "extra": t.extra}


def theme_of(r: dict) -> assign.Theme:
    return assign.Theme(r["name"], np.array(r["centre"]), tuple(r["keywords"]), tuple(r["assign_keywords"]), tuple(r["curated_keywords"]), r["match_name"], r["general"], tuple(np.array(c) for c in r["sub_centres"]), r["extra"])


def run(spark: SparkSession, table: DataFrame, config: Config, run_dir: str, source: str = "", until: str = "result", force: bool = False, embedder=None, scorer=None, clustered=None) -> Run:
    """table: row_id, question, text (long) or row_id and text columns (wide, ``input.text_cols``)."""
    embedder, scorer = embedder or backends.HashEmbedder(), scorer or backends.LexiconScorer()
    keys = stage_keys(config, source, {"embed": embedder.name, "overall": scorer.name, "aspects": scorer.name})
    stages, out = Stages(spark, run_dir), Run()

    def kept(stage: str, compute) -> DataFrame:
        df, was_there = stages.result(stage, keys[stage], compute, force)
        if was_there:
            out.cached.append(stage)
        return df

    out.answers = kept("ingest", lambda: ingest_answers(table, config, embedder))
    if until == "ingest":
        return out
    seg = rules_from(segment.SegmentRules, config.get("segment"))
    out.clauses = kept("segment", lambda: segment.cut_clauses(ingest.unique_texts(out.answers), seg))
    if until == "segment":
        return out
    cache = VectorCache(spark, f"{run_dir}/vectors", embedder.name)
    out.vectors = kept("embed", lambda: cache.vectors(out.clauses, embedder, "clause_key", "clause"))
    if until == "embed":
        return out
    per_question = config.get("themes.scope", "pooled") != "pooled"
    scoped = ingest.in_scope(out.vectors, out.answers, per_question)
    scopes = [r.scope for r in scoped.select("scope").distinct().orderBy("scope").collect()]
    themes_file = f"{run_dir}/themes-{keys['themes']}.json"
    saved = None if force else load_json(themes_file)
    if saved:
        out.cached.append("themes")
    d_rules = rules_from(discover.DiscoverRules, config.get("themes"))
    required = [discover.Required(r["name"], tuple(r.get("seeds", ())), tuple(r.get("keywords", ())), bool(r.get("general")), bool(r.get("hidden"))) for r in (x if isinstance(x, dict) else {"name": x} for x in config.get("themes.required") or [])]
    curation = config.get("themes.curation") or {}
    required += [discover.Required(name, tuple(phrases if isinstance(phrases, list) else phrases.get("seeds", ())), tuple(() if isinstance(phrases, list) else phrases.get("keywords", ()))) for name, phrases in (curation.get("add") or {}).items()]
    seeds = {name: [phrases] if isinstance(phrases, str) else list(phrases) for name, phrases in (curation.get("seeds") or {}).items()}
    frozen = FrozenGroups(spark, f"{run_dir}/frozen", int(config.get("themes.frozen_keep", 8))) if config.get("themes.freeze", True) else None
    axis = config.get("themes.sentiment_axis") or {}
    from .curation import curate

    spaces: dict[str, DataFrame] = {}
    parts = []
    a_rules = rules_from(assign.AssignRules, config.get("assign"))
    for scope in scopes:
        own = scoped.where(F.col("scope") == scope)
        if saved and scope in saved:
            out.themes[scope] = [theme_of(r) for r in saved[scope]]
            from ..functions.vectors import axis_of, centred, group_means

            mean = np.array(group_means(own.select(F.lit(0).alias("k"), "vec"), "k", "vec").first()["mean"])
            direction = axis_of(embedder.encode(axis["positive"]), embedder.encode(axis["negative"])) if axis else None
            spaces[scope] = centred(own, "vec", mean, d_rules.center_strength, direction, "_v").drop("vec").withColumnRenamed("_v", "vec")
        else:
            edit = (lambda ts: curate(ts, config.get("themes.curation"), d_rules.min_themes, bool(required))) if config.get("themes.curation") else None
            out.themes[scope], spaces[scope] = discover.discover(own, d_rules, embedder, required, axis.get("positive"), axis.get("negative"), edit, seeds, frozen)
    if not saved:
        save_json(themes_file, {s: [theme_record(t) for t in ts] for s, ts in out.themes.items()})
    if until == "themes":
        return out
    for scope in scopes:
        part, words = assign.assign_themes(spaces[scope], out.themes[scope], a_rules)
        parts.append(part.select("clause_id", "clause_key", "text_key", "clause", "scope", "theme_idx", "sim", "via"))
        out.dropped_keywords += words.dropped if words else []
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    out.assigned = kept("assign", lambda: union)
    if until == "assign":
        return out
    for scope in scopes:
        own = scoped.where(F.col("scope") == scope).select("clause_id", "clause", "text_key")
        out.report[scope] = quality.scope_report(own, out.assigned.where(F.col("scope") == scope), out.themes[scope], d_rules.name_min_coverage, d_rules.name_min_lift, d_rules.n_keywords)
    save_json(f"{run_dir}/quality.json", out.report)
    if until == "report":
        return out
    out.overall = kept("overall", lambda: backends.score_texts(ingest.unique_texts(out.answers), scorer))
    names = {s: {j: t.name for j, t in enumerate(ts)} for s, ts in out.themes.items()}

    def aspects() -> DataFrame:
        each = [backends.score_aspects(out.assigned.where(F.col("scope") == s), out.clauses, names[s], scorer) for s in scopes]
        whole = each[0]
        for e in each[1:]:
            whole = whole.unionByName(e)
        return whole

    out.aspects = kept("aspects", aspects)
    rate(out, config, scorer)
    return out


def suggest_count(spark: SparkSession, table: DataFrame, config: Config, run_dir: str, source: str = "", counts: list[int] | None = None, progress=None, **models) -> tuple[list[dict], int | None]:
    """Tries theme counts: a row of metrics for each that works, and the count to take.

    Answers, clauses and vectors are computed once; each count finds and assigns its own themes.
    """
    if counts is None:
        base = run(spark, table, config, run_dir, source, "embed", **models)
        low, high = suggest.default_range(base.vectors.count())
        counts = list(range(low, high + 1))

    def report_for(n: int) -> list[dict]:
        return list(run(spark, table, config.with_overrides({"themes": {"n_themes": n}}), run_dir, source, "report", **models).report.values())

    rows = suggest.sweep(counts, report_for, progress)
    if not rows:
        return [], None
    best = suggest.recommend(spark.createDataFrame([{k: v if k == "asked" else float(v) for k, v in r.items()} for r in rows])).first()
    return rows, int(best["asked"])


def without_non_answers(marked: DataFrame, examples: list[str], least: float, embedder) -> DataFrame:
    """Answers that mean what one of the examples means are not valid; each distinct text is embedded once."""
    texts = ingest.unique_texts(marked).select("text_key", "text_clean")
    vectors = backends.embed(texts, embedder, "text_key", "text_clean")
    near = similarities(vectors, "vec", np.asarray(embedder.encode(list(examples)), float), "_s").where(F.array_max("_s") >= least).select("text_key", F.lit(True).alias("_no"))
    valid = F.col("valid") & F.col("_no").isNull()
    return marked.join(near, "text_key", "left").withColumn("valid", valid).withColumn("text_key", F.when(valid, F.col("text_key")).otherwise("")).select(*marked.columns)


def ingest_answers(table: DataFrame, config: Config, embedder=None) -> DataFrame:
    c = config.get("input") or {}
    if c.get("text_cols"):
        ingest.check_columns(table, list(c["text_cols"]))
        table = ingest.drop_id_row(table, list(c["text_cols"]))
        answers = ingest.unpivot_answers(table, list(c["text_cols"]), c.get("id_col"))
    elif c.get("question_col") and c.get("text_col"):
        ingest.check_columns(table, [c["question_col"], c["text_col"]])
        answers = ingest.long_answers(table, c["question_col"], c["text_col"], c.get("id_col"))
    else:
        found = ingest.detect_layout(table.drop("row_id"), c.get("id_col"))
        if found.kind == "long":
            answers = ingest.long_answers(table, found.question_col, found.text_col, c.get("id_col"))
        else:
            ingest.check_columns(table, list(found.text_cols))
            answers = ingest.unpivot_answers(table, list(found.text_cols), c.get("id_col"))
    marked = ingest.mark_valid(answers, c.get("min_chars", 2), c.get("non_answer_regex"))
    if c.get("spell_correct"):
        known = table.sparkSession.read.text(c["dictionary"]).select(F.split(F.btrim("value"), r"\s+")[0].alias("word")) if c.get("dictionary") else None
        rows = spelling.corrections(marked, spelling.SpellRules(min_count=c.get("spell_min_count", 3)), spelling.protected_words(config.get("themes.protected") or []), known).collect()
        fixed = marked.withColumn("text_clean", spelling.apply_corrections("text_clean", {r.word: r.correction for r in rows}))
        marked = fixed.withColumn("valid", X.is_answer("text_clean", c.get("min_chars", 2), c.get("non_answer_regex"))).withColumn("text_key", X.text_key("text_clean", "valid"))
    if c.get("non_answer_examples"):
        marked = without_non_answers(marked, c["non_answer_examples"], float(c.get("non_answer_min_sim", 0.8)), embedder or backends.HashEmbedder())
    return marked


def learned_words(out: Run, scorer, min_support: int) -> dict[str, int]:
    """Words that mean something clearly good or bad wherever they occur, by the scorer and by this survey's ratings."""
    support = sentiment.word_support(out.aspects, out.answers.where("valid").select("text_key", "question"), min_support)
    phrases = support.select("word", F.concat(F.lit("It is "), F.col("word"), F.lit(".")).alias("phrase"))
    alone = backends.scored(phrases, scorer, "phrase")
    return {r.word: r.sign for r in sentiment.learned_valence(support, alone).collect()}


def rate(out: Run, config: Config, scorer) -> None:
    """Ratings of answers and themes, the detail rows and the wide result."""
    rules = rules_from(sentiment.RatingRules, config.get("output"))
    rules = replace(rules, spec=str(config.get("mode", "extended")).lower() == "spec")
    valence = dict(getattr(scorer, "words", {})) or None
    # a model has no list of words; the survey itself then says which words judge
    if not rules.spec and config.get("output.learn_valence", valence is None):
        valence = learned_words(out, scorer, int(config.get("output.valence_min_support", 2))) or valence
    known = X.valence_map(valence) if valence and not rules.spec else None
    g = sentiment.aggregate_ratings(out.aspects, rules, None if rules.spec else valence)
    for c in ("ev_pos", "ev_neg", "complaint"):
        if c not in g.columns:
            g = g.withColumn(c, F.lit(False))
    out.ratings = g
    joined = out.answers.join(out.overall, "text_key", "left")
    joined = joined.withColumn("code", rating.answer_code(F.col("label"), F.col("text_clean"), F.col("valid"), known, rules))
    polarity = {} if rules.spec else {r.question: r.polarity for r in rating.infer_polarity(joined.where("valid"), rules).collect()}
    given = config.get("output.question_polarity") or {}
    questions = [r.question for r in joined.select("question").distinct().orderBy("question").collect()]
    wide_parts, columns, short = [], [], ingest.short_names(questions)
    for q in questions:
        p = None
        if q in given:
            p = rules_from(rating.Polarity, {"neutral_as": rules.positive} | given[q])
        elif polarity.get(q) is not None:
            p = rating.Polarity(polarity[q], "short", themes_follow_question=True)
        own = joined.where(F.col("question") == q)
        final = rating.overall_rating(F.col("code"), F.col("text_clean"), F.col("valid"), F.col("p_pos"), F.col("p_neg"), p, rules, known)
        own = own.withColumn("overall_code", final).withColumn("lukewarm", X.lukewarm("text_clean", rules.neutral_phrases, known, rules.neutral_blockers))
        scope = "ALL" if "ALL" in out.themes else q
        themes = out.themes.get(scope, [])
        m = own.select("row_id", "text_key", "lukewarm").join(g.where(F.col("scope") == scope), "text_key")
        flags = {k: F.col(k) for k in ("ev_pos", "ev_neg", "firm_neg", "complaint")}
        m = m.withColumn("final", rating.theme_rating(F.col("code"), F.col("p_pos"), F.col("p_neg"), flags, F.col("lukewarm"), p, rules))
        names = F.create_map(*[F.lit(x) for j, t in enumerate(themes) for x in (j, t.name)])
        m = m.withColumn("theme", names[F.col("theme_idx")])
        detail = m.select("row_id", F.lit(q).alias("question"), "theme", "p_pos", "p_neg", "p_neu", "mixed", F.col("code").alias("model_code"), F.col("final").alias("code"), "lex_fix")
        out.detail = detail if out.detail is None else out.detail.unionByName(detail)
        order = [t.name for t in themes]
        pivoted = rating.wide_result(m, order, name="theme", code="final")
        w = own.select("row_id", "text", "valid", "overall_code").join(pivoted, "row_id", "left")
        general = next((t.name for t in themes if t.general), None)
        w = rating.fill_general(w, order, general, "text", "overall_code", "valid", rules)
        prefix = f"{short[q]} | " if len(questions) > 1 else ""
        w = w.select("row_id", F.col("text").alias(q), F.col("overall_code").alias(f"{prefix}Overall"), *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in order])
        columns += [f"{prefix}Overall", *[f"{prefix}{n}" for n in order]]
        wide_parts.append(w)
    # one aggregation for all questions: of a row's parts, one has each column
    every = rating.combined(wide_parts)
    wide = every.groupBy("row_id").agg(*[F.max(f"`{c}`").alias(c) for c in every.columns if c != "row_id"])
    out.result = rating.with_labels(wide, columns, rules)
