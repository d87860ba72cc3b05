"""Information-theoretic sanitisation, in DataFrame and SQL functions only.

Protected entities are e-mail addresses, IP addresses, card numbers and phone
numbers, found in whole texts.  Corpus co-occurrence then tells which words
give an entity away: with N documents, n(t) of them holding the word t, n(e)
the entity e and n(t, e) both close together, t reveals

    1 - log2(n(t) / n(t, e)) / log2(N / n(e))

of e's self-information (1: whoever reads t knows e; 0 or less: nothing).
Words near an entity that do so in ``min_contexts`` different surroundings or
more (copies of one passage are one surrounding) are generalised from
``generalise_at`` and removed from ``remove_at`` on, wherever they stand in any
document.

n(t) is counted over all documents.  Narrow rows are shuffled: the entities'
surroundings, partial word counts and the words of texts; the texts that hold a
disclosing term are joined to it.

Defined results: a null or empty text has no spans.  Rows of one id are told
apart by their texts, and repeated rows get equal results; null ids are
treated like any other.  Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.llm.common import stored, text_of

# What counts as an entity.  The look-behinds and possessive
# quantifiers change no match; they keep the scan linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without a match of these has none of the above that holds.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
KINDS = ["email", "ip", "card", "phone", "term"]
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
REACH = 80  # characters on either side of an entity, within its line

CORE = r"^[^\p{L}\d@]*(\p{L}+)[^\p{L}\d@]*$"  # a word that consists of letters, but for punctuation at its ends

_SPAN = "struct<kind:int,start:int,end:int,value:string,before:string,after:string>"


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _held(kind: str) -> Column:
    return F.filter(kind, lambda s: _holds(kind, s["value"]))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``tk`` (hash of the text) and, for each kind, the array of its
    spans (code points, end exclusive) with their surroundings."""
    frame = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("tk", F.xxhash64("text"))
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        gate = F.contains(F.col("text"), F.lit("@")) if kind == "email" else F.col("text").rlike(GATES[kind])
        for group, name in ((1, "gaps"), (2, "found")):
            # \G: each match goes on where the last one ended, so the gap before it is known.
            all_of = F.regexp_extract_all(F.col("text"), F.lit(rf"(?s)\G(.*?)({pattern})"), F.lit(group))
            frame = frame.withColumn(f"{kind}_{name}", F.when(gate, all_of).otherwise(none))
    for i, kind in enumerate(PATTERNS):
        gaps, found = f"{kind}_gaps", f"{kind}_found"
        frame = frame.withColumn(kind, F.expr(f"""
            aggregate(
              zip_with({gaps}, {found}, (g, m) -> named_struct('g', char_length(g), 'm', char_length(m))),
              named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>)),
              (a, x) -> named_struct('at', a.at + x.g + x.m,
                                     'out', concat(a.out, array(named_struct('start', a.at + x.g, 'end', a.at + x.g + x.m)))),
              a -> a.out)"""))
        frame = frame.withColumn(kind, F.expr(f"""
            transform({kind}, (s, i) -> cast(named_struct(
              'kind', {i}, 'start', s.start, 'end', s.end, 'value', {found}[i],
              'before', substring_index(if(char_length({gaps}[i]) > {REACH}, regexp_replace(right({gaps}[i], {REACH}), '^[^ \\t\\r\\n]*', ''), {gaps}[i]), '\\n', -1),
              'after', left(if(i + 1 < size({found}), left({gaps}[i + 1], {REACH} + 1), substring(text, s.end + 1, {REACH} + 1)), {REACH} + 1)) as {_SPAN}))"""))
        frame = frame.withColumn(kind, _held(kind))
    return frame.select("id", "tk", *PATTERNS)


def terms_of(text: Column) -> Column:
    """The distinct words of a text: letters only, lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\s]+", "")), r"\s+")), lambda w: F.char_length(w) >= 3)


def _near_terms(spans: DataFrame) -> DataFrame:
    """(id, tk, kind, value, around, term, start, end) of every word near an
    entity that consists of letters, but for punctuation at its ends."""
    seen = spans.select("id", "tk", F.explode(F.concat(*PATTERNS)).alias("s"))
    seen = seen.select("id", "tk", "s.kind", "s.value", F.xxhash64("s.before", "s.after").alias("around"), "s.start", "s.end", "s.before",
                       # A word cut off at the far end does not count.
                       F.expr(f"substring_index(if(char_length(s.after) > {REACH}, regexp_replace(s.after, '[^ \\t\\r\\n]*$', ''), s.after), '\\n', 1)").alias("after"))
    sides = seen.select("id", "tk", "kind", "value", "around", F.explode(F.array(
        F.struct((F.col("start") - F.char_length("before")).alias("at"), F.col("before").alias("side")),
        F.struct(F.col("end").alias("at"), F.col("after").alias("side")))).alias("x")).select("id", "tk", "kind", "value", "around", "x.at", "x.side")
    pieces = sides.select("*", F.posexplode(F.arrays_zip(
        F.regexp_extract_all("side", F.lit(r"\G(\s*)(\S+)"), F.lit(1)).alias("gap"), F.regexp_extract_all("side", F.lit(r"\G(\s*)(\S+)"), F.lit(2)).alias("word"))).alias("i", "p"))
    words = F.regexp_extract_all("side", F.lit(r"\G(\s*)(\S+)"), F.lit(0))
    ahead = F.aggregate(F.slice(words, F.lit(1), F.col("i")), F.lit(0), lambda n, w: n + F.char_length(w))
    placed = pieces.select("id", "tk", "kind", "value", "around", F.col("p.word").alias("word"), (F.col("at") + ahead + F.char_length("p.gap")).alias("at"))
    lead = F.char_length(F.regexp_extract("word", r"^([^\p{L}]*)", 1))
    core = F.regexp_extract("word", CORE, 1)
    return (placed.select("id", "tk", "kind", "value", "around", F.lower(core).alias("term"), (F.col("at") + lead).alias("start"),
                          (F.col("at") + lead + F.char_length(core)).alias("end"))
            .where(F.char_length("term") >= 3))


def disclosing_terms(docs: DataFrame, near: DataFrame, min_contexts: int = 2, generalise_at: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, value, term, revealed) of the words that give an entity away."""
    entity = ["kind", "value"]
    of_entity = near.select(*entity, "id", "tk").distinct().groupBy(*entity).agg(F.count(F.lit(1)).alias("n_e"))
    together = near.select(*entity, "term", "id", "tk").distinct().groupBy(*entity, "term").agg(F.count(F.lit(1)).alias("n_te"))
    contexts = near.select(*entity, "term", "around").distinct().groupBy(*entity, "term").agg(F.count(F.lit(1)).alias("n_c"))
    known = contexts.where(F.col("n_c") >= min_contexts).join(together, [*entity, "term"]).join(of_entity, entity)
    spread_over = (docs.select(F.explode(terms_of(text_of(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    total = docs.count()
    measured = known.join(spread_over, "term")
    information = F.greatest(F.log2(F.lit(float(total)) / F.col("n_e")), F.lit(1e-9))
    lost = F.log2(F.greatest(F.col("n_t"), F.col("n_te")) / F.col("n_te"))
    # An entity found everywhere has no information that a word could reveal.
    return (measured.where(F.col("n_e") < total).withColumn("revealed", 1 - lost / information)
            .where(F.col("revealed") >= generalise_at).select(*entity, "term", "revealed"))


def _occurrences(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, term, start, end) of every word of the texts that is one of
    ``terms`` (term), wherever it stands."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("tk", F.xxhash64("text"))
    held = texts.select("id", "tk", F.explode(terms_of(F.col("text"))).alias("term")).join(terms, "term")
    held = held.groupBy(F.col("id").alias("id_t"), F.col("tk").alias("tk_t")).agg(F.collect_set("term").alias("terms"))
    pieces = [F.regexp_extract_all("text", F.lit(r"\G(\s*)(\S+)"), F.lit(i)) for i in (1, 2)]
    placed = (texts.join(held, F.col("id").eqNullSafe(F.col("id_t")) & (F.col("tk") == F.col("tk_t")))
              .select("id", "tk", "terms", F.arrays_zip(pieces[0].alias("gap"), pieces[1].alias("word")).alias("words")))

    def step(done, x):
        core = F.regexp_extract(x["word"], CORE, 1)
        start = done["at"] + F.char_length(x["gap"]) + F.char_length(F.regexp_extract(x["word"], r"^([^\p{L}]*)", 1))
        here = F.struct(F.lower(core).alias("term"), start.alias("start"), (start + F.char_length(core)).alias("end"))
        return F.struct((done["at"] + F.char_length(x["gap"]) + F.char_length(x["word"])).alias("at"),
                        F.when(F.array_contains("terms", F.lower(core)), F.concat(done["out"], F.array(here))).otherwise(done["out"]).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<term:string,start:int,end:int>>").alias("out"))
    return placed.select("id", "tk", F.explode(F.aggregate("words", none, step, lambda done: done["out"])).alias("s")).select("id", "tk", "s.term", "s.start", "s.end")


def find(docs: DataFrame, min_contexts: int = 2, generalise_at: float = 0.8, remove_at: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``tk``, the arrays ``email``, ``ip``, ``card``, ``phone``
    and ``term`` of spans (kind, start, end), and ``removed``: the starts of
    the terms to remove (the others are generalised), for every row."""
    base = stored(base_spans(docs, id_col, text_col), "pii-spans")
    near = stored(_near_terms(base.where(F.size(F.concat(*PATTERNS)) > 0)), "pii-near")
    terms = disclosing_terms(docs, near, min_contexts, generalise_at, id_col, text_col)
    terms = stored(terms.groupBy("term").agg(F.max("revealed").alias("revealed")), "pii-terms")
    # Also near ones: beside an entity a word can stand without a space.
    places = near.select("id", "tk", "term", "start", "end").unionByName(_occurrences(docs, terms.select("term"), id_col, text_col))
    hits = (places.join(terms, "term").groupBy("id", "tk", "start", "end").agg(F.max("revealed").alias("revealed"))
            .groupBy(F.col("id").alias("id_t"), F.col("tk").alias("tk_t")).agg(
                F.sort_array(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end"))).alias("term"),
                F.sort_array(F.collect_list(F.when(F.col("revealed") >= remove_at, F.col("start")))).alias("removed")))
    joined = base.join(hits, F.col("id").eqNullSafe(F.col("id_t")) & (F.col("tk") == F.col("tk_t")), "left")
    shorter = [F.transform(k, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in PATTERNS]
    return joined.select(
        F.col("id").alias(id_col), "tk", *shorter,
        F.coalesce("term", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("term"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities and removed terms replaced by their kind, and
    generalised terms by ``<word>``; where spans overlap, the first counts."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("text_", text_of(f"c{names.index(text_col)}")).withColumn("tk_", F.xxhash64("text_"))
    spans = found.select(F.col(id_col).alias("id_f"), F.col("tk").alias("tk_f"), F.concat(*KINDS).alias("spans"), "removed").distinct()
    joined = plain.join(spans, F.col(f"c{names.index(id_col)}").eqNullSafe(F.col("id_f")) & (F.col("tk_") == F.col("tk_f")), "left")
    clean = F.expr("""
        aggregate(
          array_sort(transform(spans, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))),
          named_struct('out', '', 'at', 0),
          (a, s) -> if(s.start < a.at, named_struct('out', a.out, 'at', greatest(a.at, s.end)), named_struct(
            'out', concat(a.out, substring(text_, a.at + 1, s.start - a.at),
                          case s.kind when 0 then '<email>' when 1 then '<ip>' when 2 then '<card>' when 3 then '<phone>'
                          else if(array_contains(removed, s.start), '<term>', '<word>') end),
            'at', s.end)),
          a -> concat(a.out, substring(text_, a.at + 1)))""")
    done = F.when(F.size("spans") > 0, clean).otherwise(F.col(f"c{names.index(text_col)}"))
    return joined.withColumn(f"c{names.index(text_col)}", done).select(*(f"c{i}" for i in range(len(names)))).toDF(*names)
