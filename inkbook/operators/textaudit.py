"""Audits of text tables against allowed figures.

Texts are rows (key, text); allowed figures are rows (key, figure). Both
are exploded to canonical tokens and compared with a left-anti join on
(key, canonical), so neither side is ever gathered into one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbook.functions import text as tx


def token_rows(texts: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """One row per numeric token: keys, pos (1-based), token, canonical."""
    return texts.select(*keys, F.posexplode(tx.numeric_tokens(text_col)).alias("pos", "token")) \
        .withColumn("pos", (F.col("pos") + 1).cast("bigint")) \
        .withColumn("canonical", tx.canonical_figure("token"))


def allowed_figures(allowed: DataFrame, keys: Sequence[str], figure_col: str = "allowed") -> DataFrame:
    """Canonical allowed figures per key, de-duplicated."""
    return token_rows(allowed, keys, figure_col).select(*keys, "canonical").distinct()


def figure_violations(texts: DataFrame, allowed: DataFrame, keys: Sequence[str],
                      text_col: str = "text", figure_col: str = "allowed") -> DataFrame:
    """Tokens whose canonical form is not among the key's allowed figures."""
    toks = token_rows(texts, keys, text_col)
    ok = allowed_figures(allowed, keys, figure_col)
    return toks.join(ok, on=[*keys, "canonical"], how="left_anti")


def text_quality(texts: DataFrame, keys: Sequence[str], text_col: str = "text",
                 min_chars: int = 180) -> DataFrame:
    """Length, word count, thin text and imperative openers per text."""
    return texts.select(*keys, tx.char_count(text_col).cast("bigint").alias("n_chars"),
                        tx.word_count(text_col).cast("bigint").alias("n_words"),
                        (tx.char_count(text_col) < min_chars).alias("too_thin"),
                        tx.imperative_opener(text_col).alias("imperative"))


def audit_verdict(texts: DataFrame, allowed: DataFrame, keys: Sequence[str], label_col: str | None = None,
                  text_col: str = "text", figure_col: str = "allowed") -> DataFrame:
    """Accept a text iff it has no banned character, no hedge and no figure
    outside the allowed set; reasons in check order."""
    label = F.col(label_col) if label_col else F.lit(text_col)
    viol = figure_violations(texts, allowed, keys, text_col, figure_col).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_bad"))
    base = texts.select(*keys, label.alias("_label"), tx.hedged(text_col).alias("_h"),
                        tx.banned(text_col).alias("_b"))
    j = base.join(viol, on=list(keys), how="left")
    bad = F.transform(F.slice(F.coalesce(F.col("_bad"), F.array()), 1, 4), lambda x: x["token"])
    problems = F.filter(F.array(
        F.when(F.col("_b"), F.concat(F.col("_label"), F.lit(": contains a banned character"))),
        F.when(F.col("_h"), F.concat(F.col("_label"), F.lit(": hedged a figure with an approximation"))),
        F.when(F.size(bad) > 0, F.concat(F.col("_label"), F.lit(": quotes figures not in the data ("),
                                         F.array_join(bad, ", "), F.lit(")")))), lambda p: p.isNotNull())
    return j.select(*keys, (F.size(problems) == 0).alias("accepted"),
                    F.array_join(problems, " | ").alias("problems"))


# --- briefs in long format ----------------------------------------------------------
# A brief is rows (report_id, area, section, ordinal, field, text); section is
# one of title, metrics, hero, breakdown, actions.
BRIEF_KEYS = ("report_id", "area")


def brief_allowed(computed: DataFrame) -> DataFrame:
    """Every figure anywhere in the computed brief is allowed for its area."""
    return allowed_figures(computed.withColumnRenamed("text", "allowed"), [*BRIEF_KEYS], "allowed")


def _label(section, ordinal, field):
    """Field label as the published problems name it (metrics[0].label,
    breakdown.rows[1].description, actions.items[0].body, hero.caption)."""
    sec = F.col(section)
    path = F.when(sec == "breakdown", F.lit("breakdown.rows")).when(sec == "actions", F.lit("actions.items")) \
        .otherwise(sec)
    return F.when(sec == "title", sec) \
        .when(F.col(ordinal).isNull(), F.concat_ws(".", sec, F.col(field))) \
        .otherwise(F.concat(path, F.lit("["), F.col(ordinal).cast("string"), F.lit("]."), F.col(field)))


# Which fields are scanned for figures, hedges and banned characters.
SCANNED = {("title", None), ("hero", "caption"), ("hero", "body"), ("metrics", "label"),
           ("metrics", "sublabel"), ("breakdown", "title"), ("breakdown", "description"),
           ("actions", "title"), ("actions", "badge"), ("actions", "body")}


def brief_to_rows(brief: dict, report_id: int, area: str) -> list[tuple]:
    """Nested brief -> long rows (report_id, area, section, ordinal, field,
    text). A small per-brief helper for building test and input tables."""
    out = []

    def add(section, ordinal, field, text):
        if text is not None:
            out.append((report_id, area, section, ordinal, field, str(text)))

    add("title", None, "text", brief.get("title"))
    for i, m in enumerate(brief.get("metrics") or []):
        for f in ("label", "value", "sublabel"):
            add("metrics", i, f, m.get(f))
    for f in ("value", "caption", "body"):
        add("hero", None, f, (brief.get("hero") or {}).get(f))
    b = brief.get("breakdown") or {}
    add("breakdown", None, "title", b.get("title"))
    for j, c in enumerate(b.get("columns") or []):
        add("columns", j, "text", c)
    for i, r in enumerate(b.get("rows") or []):
        for f in ("category", "description", "value", "share"):
            add("breakdown", i, f, r.get(f))
    a = brief.get("actions") or {}
    add("actions", None, "title", a.get("title"))
    for i, it in enumerate(a.get("items") or []):
        for f in ("title", "badge", "tone", "body"):
            add("actions", i, f, it.get(f))
    return out


BRIEF_SCHEMA = "report_id bigint, area string, section string, ordinal int, field string, text string"


def brief_problems(generated: DataFrame, computed: DataFrame) -> DataFrame:
    """Problems of a generated brief: figure, hedge and banned-character
    checks on the scanned fields plus the quality rules. Returns
    (report_id, area, problem)."""
    keys = list(BRIEF_KEYS)
    # ordinal is NULL for single fields (hero, titles); join keys must not be
    g = generated.withColumn("label", _label("section", "ordinal", "field")) \
        .withColumn("ordinal", F.coalesce(F.col("ordinal"), F.lit(-1)))
    scanned = F.lit(False)
    for sec, fld in SCANNED:
        cond = F.col("section") == sec
        cond = cond & (F.col("field").isNull() | (F.col("field") == "text")) if fld is None \
            else cond & (F.col("field") == fld)
        scanned = scanned | cond
    s = g.filter(scanned & F.col("text").isNotNull() & (F.col("text") != ""))
    rid = ["report_id", "area", "section", "ordinal", "field"]
    toks = token_rows(s, [*rid, "label"])
    ok = brief_allowed(computed)
    bad = toks.join(ok, on=[*keys, "canonical"], how="left_anti").groupBy(*rid, "label").agg(
        F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_bad"))
    flags = s.select(*rid, "label", tx.hedged("text").alias("_h"), tx.banned("text").alias("_b"))
    f = flags.join(bad, on=[*rid, "label"], how="left")
    badl = F.transform(F.slice(F.coalesce(F.col("_bad"), F.array()), 1, 4), lambda x: x["token"])
    scan = f.select(*keys, F.explode(F.filter(F.array(
        F.when(F.col("_b"), F.concat(F.col("label"), F.lit(": contains a banned character"))),
        F.when(F.col("_h"), F.concat(F.col("label"), F.lit(": hedged a figure with an approximation"))),
        F.when(F.size(badl) > 0, F.concat(F.col("label"), F.lit(": quotes figures not in the data ("),
                                          F.array_join(badl, ", "), F.lit(")")))),
        lambda p: p.isNotNull())).alias("problem"))
    return scan.unionByName(brief_quality(generated))


# The problem messages are read by those who reject a text.
def brief_quality(brief: DataFrame) -> DataFrame:
    """Quality rules: a hero body of at least 180 characters that explains
    rather than instructs; a caption that finishes the headline in words; row
    descriptions of three or more words that do not repeat their own figure
    or share; action bodies of at least 90 characters with a title."""
    keys = list(BRIEF_KEYS)
    pv = brief.groupBy(*keys, "section", "ordinal").pivot(
        "field", ["body", "caption", "value", "description", "share", "title"]).agg(F.first("text"))

    def t(c):
        return F.trim(F.coalesce(F.col(c), F.lit("")))

    has_digit = lambda c: t(c).rlike("[0-9]")
    hero = pv.filter(F.col("section") == "hero")
    rows = pv.filter((F.col("section") == "breakdown") & F.col("ordinal").isNotNull())
    acts = pv.filter(F.col("section") == "actions")
    ordn = F.col("ordinal").cast("string")
    hero_p = hero.select(*keys, F.explode(F.filter(F.array(
        F.when(F.length(t("body")) < 180, F.lit("hero.body: too thin to be a finding")),
        F.when(tx.imperative_opener(t("body")), F.lit("hero.body: gives instructions instead of explaining")),
        F.when((t("caption") == "") | (t("caption") == t("value")) | ~t("caption").rlike("[A-Za-z]"),
               F.lit("hero.caption: must finish the headline figure in words, not repeat it"))),
        lambda p: p.isNotNull())).alias("problem"))
    row_p = rows.select(*keys, F.explode(F.filter(F.array(
        F.when(F.size(F.regexp_extract_all(t("description"), F.lit(r"\S+"), 0)) < 3,
               F.concat(F.lit("breakdown.rows["), ordn, F.lit("]: description says nothing"))),
        F.when((t("value") != "") & has_digit("value") & t("description").contains(t("value")),
               F.concat(F.lit("breakdown.rows["), ordn, F.lit("]: description repeats its own figure")))
        .when((t("share") != "") & has_digit("share") & t("description").contains(t("share")),
              F.concat(F.lit("breakdown.rows["), ordn, F.lit("]: description repeats its own share")))),
        lambda p: p.isNotNull())).alias("problem"))
    act_p = acts.filter(F.col("ordinal").isNotNull()).select(*keys, F.explode(F.filter(F.array(
        F.when(F.length(t("body")) < 90, F.concat(F.lit("actions.items["), ordn,
                                                 F.lit("]: no reasoning behind the action"))),
        F.when(t("title") == "", F.concat(F.lit("actions.items["), ordn, F.lit("]: missing title")))),
        lambda p: p.isNotNull())).alias("problem"))
    return hero_p.unionByName(row_p).unionByName(act_p)


def brief_verdict(generated: DataFrame, computed: DataFrame) -> DataFrame:
    """(report_id, area, accepted, problems) for every generated brief."""
    keys = list(BRIEF_KEYS)
    probs = brief_problems(generated, computed).groupBy(*keys).agg(F.collect_list("problem").alias("problems"))
    briefs = generated.select(*keys).distinct()
    return briefs.join(probs, on=keys, how="left").select(
        *keys, F.coalesce(F.size("problems") == 0, F.lit(True)).alias("accepted"),
        F.coalesce(F.col("problems"), F.array().cast("array<string>")).alias("problems"))


def authoritative_merge(generated: DataFrame, computed: DataFrame) -> DataFrame:
    """Force every figure field back to the computed brief by position: hero
    value, metric values, row value/share/category and table columns. The
    generated caption survives only if it is prose and not the figure."""
    keys = ["report_id", "area", "section", "ordinal", "field"]
    forced = ((F.col("section") == "hero") & (F.col("field") == "value")) | \
        ((F.col("section") == "metrics") & (F.col("field") == "value")) | \
        ((F.col("section") == "breakdown") & F.col("field").isin("value", "share", "category", "columns"))
    nn = F.coalesce(F.col("ordinal"), F.lit(-1)).alias("_o")
    comp = computed.select(*keys[:3], nn, "field", F.col("text").alias("_c"))
    j = generated.select("*", nn).join(comp, on=[*keys[:3], "_o", "field"], how="left").drop("_o")
    hero_val = computed.filter((F.col("section") == "hero") & (F.col("field") == "value")) \
        .select("report_id", "area", F.trim(F.col("text")).alias("_hv"))
    hero_cap = computed.filter((F.col("section") == "hero") & (F.col("field") == "caption")) \
        .select("report_id", "area", F.col("text").alias("_hc"))
    j = j.join(hero_val, on=["report_id", "area"], how="left").join(hero_cap, on=["report_id", "area"], how="left")
    cap = F.trim(F.coalesce(F.col("text"), F.lit("")))
    bad_cap = (cap == "") | (cap == F.coalesce(F.col("_hv"), F.lit(""))) | ~cap.rlike("[A-Za-z]")
    is_cap = (F.col("section") == "hero") & (F.col("field") == "caption")
    text = (F.when(forced & F.col("_c").isNotNull(), F.col("_c"))
            .when(forced & (F.col("section") == "hero"), F.coalesce(F.col("_c"), F.lit("")))
            .when(is_cap & bad_cap, F.coalesce(F.col("_hc"), F.lit("")))
            .otherwise(F.col("text")))
    return j.select(*keys, text.alias("text"))
