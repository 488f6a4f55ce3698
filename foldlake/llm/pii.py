"""Personal data: fixed patterns, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Each distinct value found is a protected
entity. A term (a word of four letters or more, lower-cased) near an entity's mentions discloses it as far as

    PMI(term; entity) / IC(entity) = log(n_et * N / (n_e * n_t)) / log(N / n_e)

for N documents, of which n_e hold the entity, n_t the term and n_et the term near the entity: 1 when the term only
occurs with the entity. Terms at ``generalise_at`` or more are generalised to a category (``<name>`` for a word with a
capital, else ``<word>``), at ``remove_at`` or more removed, if at least ``min_support`` different contexts show the pair
(copies of one passage count once). n_t is counted over the whole corpus. Documents are counted as different pairs of id
and text, in all four numbers. Nearness is evidence only: a disclosing term is found wherever it stands, far from a mention
and in documents without the entity too; it is removed if any of its entities says so. DataFrame functions only.

Defined results: null text is empty and has no spans. Positions are code points, ends exclusive. Repeated rows get the
same result each. Null ids stay null. A corpus in which every document holds an entity discloses nothing about it.
Texts of any length are read whole; a context is the ``window`` characters on either side of a mention. Words are
lower-cased one by one, so that places are those of the text as it is.

The time is linear in a text's length and all but linear in what is found in it: places are running sums over blocks of
pieces, contexts come from the patterns' own look-around, and whether a word overlaps a span is seen from the letters
beside it, since of all spans only e-mail addresses hold letters, and these are marked in the text once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

KINDS = ("email", "ip", "card", "phone", "term")

# Possessive forms of the patterns: what follows each repeat cannot match within it, so nothing is lost, and long runs
# need no stack. A run of word characters is tried from its start only (or from the end of the last match).
_W = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_W})){_W}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{4,}"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_TERMS = "array<struct<start:int,kind:int,end:int,remove:boolean>>"
_MATCH = "array<struct<start:int,end:int,m:string>>"
_MENTIONS = "array<struct<entity:string,ctx:bigint,terms:array<struct<term:string,start:int,end:int>>>>"
#: Pieces of a text whose places are summed up together.
BLOCK = 64
#: Stands for a letter of an e-mail address (a private-use character), and for itself where the text has it.
MARK, OWN = "\uE000", "\uE001"
#: A term none of whose letters is an address's.
FREE = rf"(?<![\p{{L}}{MARK}])\p{{L}}{{4,}}+(?!{MARK})"


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w))


def let(value: Column, body) -> Column:
    """body(value), with ``value`` worked out once however often ``body`` names it, in functions over arrays too."""
    return F.transform(F.array(value), body)[0]


def blocks_of(array: Column) -> Column:
    """An array in blocks of BLOCK elements."""
    def cut_up(a: Column) -> Column:
        last = F.greatest(F.ceil(F.size(a) / BLOCK).cast("int") - 1, F.lit(0))
        return F.filter(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK))), lambda block: F.size(block) > 0)

    return let(array, cut_up)


def placed(gaps: Column, found: Column, make, kind: str) -> Column:
    """make(start, end, m) of each piece ``found``, of which each follows a gap; null ones fall out. Places are running sums: over
    blocks of BLOCK pieces, then within each, so that no array grows by one element for each piece of the text."""
    pieces = F.zip_with(gaps, found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,block:array<struct<gap:int,size:int,m:string>>>>").alias("out"))

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + p["size"])

    def after(acc, b):
        return F.struct((acc["at"] + total(b)).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("at"), b.alias("block"))).alias("out"))

    def inside(block: Column) -> Column:
        begin = F.struct(block["at"].alias("at"), F.array().cast(kind).alias("out"))

        def add(acc, p):
            here = acc["at"] + p["gap"]
            made = make(here, here + p["size"], p["m"])
            return F.struct((here + p["size"]).alias("at"), F.when(made.isNotNull(), F.array_append(acc["out"], made)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block["block"], begin, add, lambda acc: acc["out"])

    return F.flatten(F.transform(F.aggregate(blocks_of(pieces), start, after, lambda acc: acc["out"]), inside))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places, from the matches and the gaps between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    return placed(gaps, found, lambda start, end, m: F.struct(start.alias("start"), end.alias("end"), m.alias("m")), _MATCH)


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def value(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


#: Cheap tests that a text without a match mostly fails.
_HINTS = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": lambda t: t.contains("+"),
}


def base_matches(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
    return F.when(_HINTS[kind](text), found).otherwise(F.array().cast(_MATCH))


def _entity(kind: str, m: Column) -> Column:
    value = F.lower(m) if kind in ("email", "ip") else F.regexp_replace(m, "[^0-9]", "")
    return F.concat(F.lit(kind + ":"), value)


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _text, a column of matches for each kind (_email ...), and _base: all spans by start, then kind as listed."""
    d = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumn("_marked", marked(F.col("_text")))
    d = d.withColumns({f"_{k}": base_matches(F.col("_text"), k) for k in KINDS[:4]})

    def spans(i: int) -> Column:
        return F.transform(f"_{KINDS[i]}", lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))

    return d.withColumn("_base", F.array_sort(F.concat(*[spans(i) for i in range(4)])))


def marked(text: Column) -> Column:
    """The text with every letter of an e-mail address as MARK: as long as before, and with the same matches of each pattern."""
    plain = F.translate(text, MARK, OWN)
    found = F.regexp_extract_all(plain, F.lit(PATTERNS["email"]), F.lit(0))
    gaps = F.split(plain, PATTERNS["email"], -1)
    masks = F.concat(F.transform(found, lambda m: F.regexp_replace(m, "[A-Za-z]", MARK)), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(gaps, masks, lambda g, m: F.concat(g, m)), "")
    return F.when(plain.contains("@"), whole).otherwise(plain)


def _around(text: Column, kind: str, window: int, mark: str = "") -> tuple[Column, Column]:
    """The ``window`` characters before and after each match, fewer at the text's ends."""
    inner = PATTERNS[kind].replace("[A-Za-z0-9", f"[{mark}A-Za-z0-9") if mark else PATTERNS[kind]
    # the match is looked for first: only where there is one is the text before it read
    whole = rf"(?s)(?=(?:{inner}))(?<=(^.{{0,{window - 1}}}|.{{{window}}}))(?:{inner})(?=(.{{0,{window}}}))"
    return F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))


def _mentions(window: int) -> Column:
    """Of with_base(): array of (entity, ctx, terms: array of (term, start, end)) for each base span."""
    text, other = F.col("_text"), F.col("_marked")

    def terms(near: Column, begin: Column, open_left: Column, open_right: Column) -> Column:
        size = F.char_length(near)
        whole = F.filter(matches(near, FREE), lambda t: ~((open_left & (t["start"] == 0)) | (open_right & (t["end"] >= size))))
        return F.transform(whole, lambda t: F.struct(F.lower(t["m"]).alias("term"), (begin + t["start"]).alias("start"), (begin + t["end"]).alias("end")))

    def mention(kind: str, length: Column):
        def of(x):
            left, right = F.char_length(x["l"]), F.char_length(x["r"])
            begin = x["start"] - left
            return F.struct(
                _entity(kind, x["m"]).alias("entity"), F.xxhash64(F.lower(F.concat(x["l"], F.lit("\n"), x["r"]))).alias("ctx"),
                F.concat(terms(x["a"], begin, begin > 0, F.lit(True)), terms(x["b"], x["end"], F.lit(True), x["end"] + right < length)).alias("terms"),
            )
        return of

    def every(kind: str) -> Column:
        parts = (matches(text, PATTERNS[kind]), *_around(text, kind, window), *_around(other, kind, window, MARK))
        found = F.arrays_zip(*[p.alias(n) for n, p in zip(("x", "l", "r", "a", "b"), parts, strict=True)])
        found = F.filter(found, lambda f: _valid(kind, f["x"]["m"]))
        found = F.transform(found, lambda f: F.struct(f["x"]["start"].alias("start"), f["x"]["end"].alias("end"), f["x"]["m"].alias("m"), f["l"].alias("l"), f["r"].alias("r"), f["a"].alias("a"), f["b"].alias("b")))
        return F.when(F.size(f"_{kind}") > 0, let(F.char_length(text), lambda n: F.transform(found, mention(kind, n)))).otherwise(F.array().cast(_MENTIONS))

    return F.concat(*[every(k) for k in KINDS[:4]])


def base_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 60) -> DataFrame:
    """Written table of (doc_id, _t, n_email ..., _base, _mentions): what the patterns find, without the texts."""
    d = with_base(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    return cut(d.select(
        "doc_id", F.xxhash64("text").alias("_t"), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]], "_base",
        F.when(F.size("_base") > 0, _mentions(window)).otherwise(F.array().cast(_MENTIONS)).alias("_mentions"),
    ), "pii_base")


def disclosing_terms(docs: DataFrame, base: DataFrame, **options) -> DataFrame:
    """Written table (entity, term, n_et, n_e, n_t, disclosure, action) of the pairs over the threshold."""
    return disclosed(docs, base, **options)[0]


def disclosed(docs: DataFrame, base: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_support: int = 2,
              generalise_at: float = 0.8, remove_at: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(pairs, said): disclosing_terms(), and a written table (doc_id, _t, term) of the documents that hold a term which may
    disclose: all words of all documents are looked at once."""
    x = base.filter(F.size("_mentions") > 0).select("doc_id", "_t", F.explode("_mentions").alias("x"))
    m = x.select("doc_id", "_t", "x.entity", "x.ctx", F.explode("x.terms").alias("y")).select("doc_id", "_t", "entity", "ctx", "y.*")
    row = F.struct("doc_id", "_t")
    n = base.select("doc_id", "_t").distinct().count()

    def disclosure(n_t: Column) -> Column:
        pmi = F.log(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * n_t))
        ic = F.log(F.lit(float(max(n, 1))) / F.col("n_e"))
        return F.round(F.when(ic > 0, pmi / ic), 9)

    near = m.groupBy("entity", "term").agg(F.countDistinct("ctx").alias("support"), F.countDistinct(row).alias("n_et")).filter(F.col("support") >= min_support)
    entities = x.groupBy(F.col("x.entity").alias("entity")).agg(F.countDistinct(row).alias("n_e"))
    # A term is in at least the documents that have it near some mention: pairs that fail with that count need no other.
    least = m.groupBy("term").agg(F.countDistinct(row).alias("n_near"))
    near = near.join(entities, "entity").join(least, "term").filter(disclosure(F.col("n_near")) >= generalise_at)
    near = cut(near.select("entity", "term", "n_et", "n_e"), "pii_near")
    wanted = cut(near.select("term").distinct(), "pii_terms")
    said = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_t"), F.explode(F.array_distinct(_words(F.col(text_col)))).alias("term"))
    said = cut(said.join(small(wanted), "term", "left_semi"), "pii_said")  # others need not be counted
    counts = said.groupBy("term").agg(F.countDistinct(row).alias("n_t"))
    pairs = near.join(counts, "term").withColumn("disclosure", disclosure(F.col("n_t")))
    pairs = pairs.filter(F.col("disclosure") >= generalise_at).withColumn("action", F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise"))
    return cut(pairs.select("entity", "term", "n_et", "n_e", "n_t", "disclosure", "action"), "pii_pairs"), said


def term_spans(docs: DataFrame, pairs: DataFrame, said: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _t, _terms: array of (start, kind, end, remove)) for the documents in which a term of ``pairs`` stands
    anywhere outside the patterns' spans; a written table."""
    terms = cut(pairs.groupBy("term").agg(F.max(F.col("action") == "remove").alias("remove")), "pii_removed")
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("_t"), F.col(text_col).alias("text"))
    held = said.join(small(terms), "term").groupBy("doc_id", "_t").agg(F.map_from_entries(F.collect_set(F.struct("term", "remove"))).alias("_held"))
    held = small(cut(held, "pii_held").withColumnsRenamed({"doc_id": "_id", "_t": "_u"}))
    d = d.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u"))).withColumn("_text", marked(F.coalesce("text", F.lit(""))))
    found = F.regexp_extract_all("_text", F.lit(FREE), F.lit(0))
    gaps = F.slice(F.split("_text", FREE, -1), 1, F.size(found))

    def make(start: Column, end: Column, m: Column) -> Column:
        remove = F.element_at(F.col("_held"), F.lower(m))
        return F.when(remove.isNotNull(), F.struct(start.alias("start"), F.lit(4).alias("kind"), end.alias("end"), remove.alias("remove")))

    spans = d.select("doc_id", "_t", placed(gaps, found, make, _TERMS).alias("_terms")).filter(F.size("_terms") > 0)
    return cut(spans.dropDuplicates(["doc_id", "_t"]), "pii_spans")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 60, min_support: int = 2,
             generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone, base (array of spans), terms (array of spans)."""
    base = base_table(docs, id_col=id_col, text_col=text_col, window=window)
    pairs, said = disclosed(docs, base, id_col=id_col, text_col=text_col, min_support=min_support, generalise_at=generalise_at, remove_at=remove_at)
    spans = term_spans(docs, pairs, said, id_col=id_col, text_col=text_col).withColumnsRenamed({"doc_id": "_id", "_t": "_u"})
    out = base.join(small(spans), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u")), "left")
    terms = F.transform(F.coalesce("_terms", F.array().cast(_TERMS)), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], F.col("_base").alias("base"), terms.cast(_SPAN).alias("terms"))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 60, min_support: int = 2,
             generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """``docs`` with ``<email>`` and the like in place of what is found, generalised terms by category; all else as it was. Overlapping spans become one."""
    columns = docs.columns
    base = base_table(docs, id_col=id_col, text_col=text_col, window=window)
    pairs, said = disclosed(docs, base, id_col=id_col, text_col=text_col, min_support=min_support, generalise_at=generalise_at, remove_at=remove_at)
    spans = small(term_spans(docs, pairs, said, id_col=id_col, text_col=text_col).withColumnsRenamed({"doc_id": "_id", "_t": "_u"}))
    row = F.struct(*[F.col(f"`{c}`") for c in columns])  # out of the way of our own names
    d = with_base(docs.select(row.alias("_row"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_raw")), "_raw")
    d = d.join(spans, F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64("_raw") == F.col("_u")), "left")
    marked = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("remove")))
    every = F.array_sort(F.concat(marked, F.coalesce("_terms", F.array().cast(_TERMS))))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS[:4]])
    text = F.col("_text")

    # spans that begin before another has ended are part of it; each of the others knows where the text before it begins
    kept = "array<struct<from:int,start:int,end:int,kind:int,remove:boolean>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kept).alias("out"))

    def keep(acc, s):
        one = F.struct(acc["at"].alias("from"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["remove"].alias("remove"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    d = d.withColumn("_every", every).withColumn("_kept", F.aggregate("_every", begin, keep)).withColumns({"_end": F.col("_kept.at"), "_kept": F.col("_kept.out")})

    def pieces(block: Column) -> Column:
        """Blocks of spans cut their own part out of the text first, so that no span is looked for from the text's start."""
        first = block[0]["from"]

        def one(part: Column, s: Column) -> Column:
            category = F.when(F.substring(part, s["start"] - first + 1, F.lit(1)).rlike(r"\p{Lu}"), "<name>").otherwise("<word>")
            mark = F.when(s["remove"], F.lit("")).when(s["kind"] == 4, category).otherwise(F.try_element_at(names, s["kind"] + 1))
            return F.concat(F.substring(part, s["from"] - first + 1, s["start"] - s["from"]), mark)

        own = F.substring(text, first + 1, F.element_at(block, -1)["end"] - first)
        return let(own, lambda part: F.array_join(F.transform(block, lambda s: one(part, s)), ""))

    clean = F.concat(F.array_join(F.transform(blocks_of(F.col("_kept")), pieces), ""), F.substring(text, F.col("_end") + 1, F.char_length(text)))
    d = d.withColumn("_clean", F.when(F.size("_every") > 0, clean).otherwise(F.col("_raw")))
    return d.select(*[F.col("_clean" if c == text_col else f"_row.`{c}`").alias(c) for c in columns])
