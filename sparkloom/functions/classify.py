"""Keyword classification, routing, safety and question policy as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import lexicon as L
from sparkloom.functions import text as T


def keyword_hits(c: Column, words: list[str]) -> Column:
    """How many of the listed words the lower-cased text contains, each counted once."""
    low = F.lower(c)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0])).cast("int"))


def contains_any(c: Column, words: list[str]) -> Column:
    """The lower-cased text contains one of the words."""
    return keyword_hits(c, words) > 0


def _best(scores: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Name (first listed among equals), best and second best score."""
    ordered = F.sort_array(F.array(*scores.values()), asc=False)
    best, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    name = F.lit(None).cast("string")
    for k in reversed(scores):
        name = F.when(scores[k] == best, k).otherwise(name)
    return name, best, second


def classify_chunk(titles: Column, content: Column, prior: Column) -> Column:
    """Category of a chunk: decisive titles, else decisive content, else the document's own; a general prior gives way to content."""
    t_name, t_best, t_second = _best({k: keyword_hits(titles, w) for k, w in L.CHUNK_KEYWORDS.items()})
    c_name, c_best, c_second = _best({k: keyword_hits(content, w) for k, w in L.CHUNK_KEYWORDS.items()})
    return (
        F.when((t_best >= 2) & (t_best >= t_second + 2), t_name)
        .when((c_best >= 3) & (c_best >= c_second + 2), c_name)
        .when((prior == "general") & (c_best >= 2), c_name)
        .otherwise(prior)
    )


def document_category(name: Column, mapping: dict[str, str]) -> Column:
    """The category of the first listed part that the name contains; general if none."""
    out = F.lit("general")
    for part, category in reversed(mapping.items()):
        out = F.when(F.contains(F.lower(name), F.lit(part.lower())), category).otherwise(out)
    return out


def route(query: Column, selected: Column) -> Column:
    """The category to search: the selected one, else a clearly leading one, else all."""
    name, best, second = _best({k: keyword_hits(T.strip(query), w) for k, w in L.ROUTE_SIGNALS.items()})
    return F.when(selected != "all", selected).when((best >= 2) & (best >= second + 1), name).otherwise("all")


def safety_level(query: Column) -> Column:
    out = F.lit("informational")
    for level in reversed(L.SAFETY_SIGNALS):
        out = F.when(keyword_hits(query, L.SAFETY_SIGNALS[level]) >= 1, level).otherwise(out)
    return out


def _array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _policy_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}_؀-ۿ]+"), F.lit(0)))


def needs_clarification(query: Column, has_context: Column) -> Column:
    """The question is blank, vague or without content words, and the user has said nothing before to go by."""
    clean = F.regexp_replace(F.regexp_replace(T.sanitize(F.lower(query)), "^[ .?!؟]+", ""), r"[ .?!؟]+\z", "")
    words = _policy_tokens(clean)
    return (
        F.when(clean == "", True)
        .when(clean.isin(L.VAGUE_QUESTIONS), ~has_context)
        .when(F.arrays_overlap(words, _array(L.DOMAIN_ANCHORS)), False)
        .otherwise((F.size(F.array_except(words, _array(L.LIGHT_WORDS))) < 2) & ~has_context)
    )


def mentions_domain(c: Column) -> Column:
    low = F.lower(c)
    found = F.arrays_overlap(_policy_tokens(c), _array(L.DOMAIN_ANCHORS))
    for part in L.DOMAIN_FRAGMENTS:
        found = found | F.contains(low, F.lit(part))
    return found


def is_out_of_domain(query: Column, history: Column) -> Column:
    """Neither the question nor what the user said before (texts) names the domain."""
    return ~mentions_domain(query) & ~F.exists(history, mentions_domain)


def unsupported_type(query: Column) -> Column:
    """Asks about a type other than 1 and 2."""
    number = F.regexp_extract(F.lower(query), r"\btype\s*([0-9]+)\b", 1)
    return (number != "") & ~number.isin("1", "2") | contains_any(query, L.OTHER_TYPES)


def is_follow_up(query: Column) -> Column:
    found = F.lit(False)
    for pattern in L.FOLLOW_UPS:
        found = found | query.rlike("(?iU)" + pattern)
    return found


def hints(query: Column) -> Column:
    """Wordings to search instead, for questions in either language that ask for known figures."""

    def found(rules: list[tuple[list[list[str]], str]]) -> Column:
        out = []
        for groups, hint in rules:
            met = F.lit(True)
            for words in groups:
                met = met & contains_any(query, words)
            out.append(F.when(met, hint))
        return F.array_compact(F.array(*out))

    return F.when(T.is_arabic(query), found(L.HINTS["ar"])).otherwise(found(L.HINTS["en"]))


def evidence_groups(query: Column) -> Column:
    """Groups of terms; evidence must contain one of each: the first condition that the question names, risk factors, cardiology."""
    q = T.sanitize(F.regexp_replace(F.lower(query), "–", "-"))
    words = lambda ws: F.array(*map(F.lit, ws))
    condition = F.lit(None).cast("array<string>")
    for asked, wanted in reversed(L.CONDITIONS):
        condition = F.when(contains_any(q, asked), words(wanted)).otherwise(condition)
    risk = F.when(contains_any(q, L.CONDITIONS[1][0]) & contains_any(q, L.RISK_QUESTIONS), words(L.TYPE_2_RISK_EVIDENCE)).when(contains_any(q, L.RISK_QUESTIONS), words(L.RISK_EVIDENCE))
    cardiology = F.when(contains_any(q, L.CARDIOLOGY_QUESTIONS), words(L.CARDIOLOGY_EVIDENCE))
    return F.array_compact(F.array(condition, risk, cardiology))


def matches_directly(groups: Column, evidence: Column) -> Column:
    text = T.sanitize(F.lower(evidence))
    return F.forall(groups, lambda g: F.exists(g, lambda w: F.contains(text, w)))


def disclaimer(level: Column, arabic: Column) -> Column:
    out = F.lit("")
    for name, (english, other) in L.DISCLAIMERS.items():
        out = F.when(level == name, F.when(arabic, other).otherwise(english)).otherwise(out)
    return out


def language(c: Column) -> Column:
    """The language whose frequent words the text has most of; texts under 20 characters and ties go to the one listed first."""
    words = T.tokens(F.substring(c, 1, 3000))

    def frequent(own: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(own)))

    scores = {k: frequent(own) for k, own in L.LANGUAGE_WORDS.items()}
    top = F.greatest(*scores.values())
    out = F.lit("en")
    for name in reversed(scores):
        out = F.when(scores[name] == top, name).otherwise(out)
    return F.when(F.length(T.strip(F.coalesce(c, F.lit("")))) < 20, "en").otherwise(out)


def rewrite(query: Column, last_user: Column, has_history: Column) -> Column:
    """Follow-ups get the last user turn in front, short questions without history a context suffix; hints replace all of it."""
    own = T.strip(query)
    longer = F.when(T.is_arabic(own), F.concat(own, F.lit(L.CONTEXT_SUFFIX_AR))).otherwise(F.concat(own, F.lit(L.CONTEXT_SUFFIX)))
    out = (
        F.when(own == "", own)
        .when(is_follow_up(own) & has_history & (F.coalesce(last_user, F.lit("")) != ""), F.concat(T.strip(last_user), F.lit(". "), own))
        .when((F.length(own) < L.MIN_STANDALONE) & ~has_history, longer)
        .otherwise(own)
    )
    found = hints(own)
    return F.when((own != "") & (F.size(found) > 0), F.array_join(found, "; ")).otherwise(T.sanitize(out))


def is_reference_only(section: Column, body: Column) -> Column:
    """A bibliography rather than content, by its section's title or how it begins."""
    title = F.regexp_replace(T.sanitize(F.lower(F.coalesce(section, F.lit("")))), r"^[ :.-]+|[ :.-]+\z", "")
    return title.isin("references", "reference", "bibliography", "المراجع") | T.sanitize(F.lower(body)).rlike("^(references|bibliography|المراجع) ")
