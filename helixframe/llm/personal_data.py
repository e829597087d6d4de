"""Personal data: patterns of four kinds, and terms that reveal what they found, by corpus co-occurrence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, cut, split_join, stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Leftmost, non-overlapping matches as of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+` and so on. Looking back
#: and not giving back what is taken change no match, but make every search linear in the text.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Terms are these runs with A-Z lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What a term may be generalised to; a class counts as a term of every document that has one of its words.
CLASSES = ("number", "name", "word")
_LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
_DIGITLESS = rf"(?<!{_WORD[:-1]}){{}}{_LETTER}*+(?!{_WORD[:-1]})"
#: A text has a word of the class exactly if this is found in it.
_HAS = {"number": "[0-9]", "name": _DIGITLESS.format(r"(?=\p{Lu})"), "word": _DIGITLESS.format(rf"(?!\p{{Lu}})(?={_LETTER})")}
#: Terms of at most so many rows are broadcast (a long each); more are joined by a shuffle.
BROADCAST_TERMS = 500_000
#: Of an array of widths, so many are added up at a time.
_STEP = 256
_PIECE = 1024


def _valid(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return ~F.exists(F.split(hit, r"\."), lambda part: F.char_length(F.ltrim(part, F.lit("0"))) > 3) & ~F.exists(F.split(hit, r"\."), lambda part: F.coalesce(F.right(part, F.lit(3)).cast("int"), F.lit(0)) > 255)
    if kind == "card":
        return F.when(F.char_length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _value(kind: str, hit: Column) -> Column:
    """What tells one entity of the kind from another, whatever its spelling."""
    return ascii_lower(hit) if kind == "email" else hit if kind == "ip" else F.regexp_replace(hit, "[^0-9]", "")


def _running(values: str, fold: str) -> str:
    """SQL: the running fold(a, x) of an array of ints, each element's own included. It goes by steps, so that long arrays aren't copied for every element."""
    bound = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"  # noqa: E731  names a value within an expression
    steps = f"if(size(v) = 0, cast(array() as array<array<int>>), transform(sequence(0, greatest(size(v) - 1, 0) div {_STEP}), b -> slice(v, b * {_STEP} + 1, {_STEP})))"
    inner = "aggregate(slice({0}, 2, size({0})), array({0}[0]), (a, x) -> array_append(a, {1}))"
    each = f"transform(bs, b -> {inner.format('b', fold.replace('$a', 'element_at(a, -1)'))})"
    ends = "transform(rs, r -> element_at(r, -1))"
    carry = f"if(size(es) < 2, es, {inner.format('es', fold.replace('$a', 'element_at(a, -1)'))})"
    whole = f"flatten(transform(rs, (r, j) -> if(j = 0, r, transform(r, x -> {fold.replace('$a', 'cs[j - 1]')}))))"
    return bound("v", values, bound("bs", steps, bound("rs", each, bound("es", ends, bound("cs", carry, whole)))))


def _starts(gaps: str, hits: str) -> str:
    """SQL: where each hit starts in code points, from the gaps before them. Columns stand outside of lambdas, or the optimiser may put what makes them inside, once an element."""
    ends = _running(f"zip_with({hits}, slice({gaps}, 1, size({hits})), (h, g) -> char_length(h) + char_length(g))", "$a + x")
    return f"zip_with({ends}, {hits}, (e, h) -> e - char_length(h))"


def _found(d: DataFrame, window: int) -> DataFrame:
    """d with one column a kind: its valid matches with start, end, entity and the terms around them."""
    gate = {"email": F.col("text").contains("@"), "ip": F.rlike("text", F.lit(r"[0-9]\.[0-9]")), "card": F.rlike("text", F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), "phone": F.rlike("text", F.lit(r"\+[0-9]"))}
    for kind in KINDS:
        d = d.withColumn("gated", F.when(gate[kind], F.col("text")))
        d = d.withColumn("hits", F.regexp_extract_all("gated", F.lit(PATTERNS[kind]), F.lit(0)))
        d = d.withColumn("gaps", F.when(F.size("hits") > 0, F.split("gated", PATTERNS[kind], -1)))
        d = d.withColumn("starts", F.when(F.size("hits") > 0, F.expr(_starts("gaps", "hits"))))
        # whole words of the gap on each side; one that touches a match is none of its own
        words = lambda gap: F.regexp_extract_all(gap, F.lit(_WORD), F.lit(0))
        whole = lambda gap: words(F.regexp_replace(gap, rf"^{_WORD}|{_WORD}\z", " "))
        # at the ends of the text nothing is touched
        left = lambda i: whole(F.when(i == 0, F.concat(F.lit(" "), F.get("gaps", i))).otherwise(F.get("gaps", i)))
        right = lambda i: whole(F.when(i == F.size("hits") - 1, F.concat(F.get("gaps", i + 1), F.lit(" "))).otherwise(F.get("gaps", i + 1)))
        some = F.filter(F.transform("hits", lambda h, i: F.struct(h.alias("hit"), i.alias("i"))), lambda x: _valid(kind, x["hit"]))
        spans = F.transform(
            some,
            lambda x: F.struct(
                F.get("starts", x["i"]).alias("start"),
                F.lit(KINDS.index(kind)).alias("order"),
                (F.get("starts", x["i"]) + F.char_length(x["hit"])).alias("end"),
                F.lit(kind).alias("kind"),
                F.xxhash64(F.lit(kind), _value(kind, x["hit"])).alias("entity"),
                # the last words before it and the first ones after it
                F.concat(F.reverse(F.slice(F.reverse(left(x["i"])), 1, window)), F.slice(right(x["i"]), 1, window)).alias("around"),
            ),
        )
        d = d.withColumn(kind, F.coalesce(F.when(F.size("hits") > 0, spans), F.array().cast("array<struct<start:int,order:int,end:int,kind:string,entity:bigint,around:array<string>>>")))
    return d.withColumn("base", F.array_sort(F.concat(*KINDS))).drop("gated", "hits", "gaps", "starts", *KINDS)


def _class_of(word: Column) -> Column:
    """The class that a word generalises to."""
    return F.when(F.rlike(word, F.lit("[0-9]")), "number").when(F.rlike(word, F.lit(r"^\p{Lu}")), "name").otherwise("word")


def _term(word: Column) -> Column:
    return F.xxhash64(ascii_lower(word))


def _class_term(word: Column) -> Column:
    return F.xxhash64(F.lit("class"), _class_of(word))


def _key() -> Column:
    """A row's id and text; rows in which both are equal get equal results."""
    return F.struct(F.xxhash64("id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "id").alias("b"))


def _only(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Those of rows whose term is among terms (term, ...), with the columns of terms."""
    if terms.count() <= BROADCAST_TERMS:
        return rows.join(F.broadcast(terms), "term")
    return split_join(rows, terms, ["term"])


def disclosing_terms(found: DataFrame, docs: DataFrame, disclosure: float, contexts: int) -> DataFrame:
    """(term): the hashes of the terms, and of the classes of words, that reveal an entity of found (base); docs is (text).

    With n documents, of which n_c hold entity c, n_t the term t and n_ct the term within the
    window of the entity, PMI(c;t) = log(n n_ct / (n_c n_t)) and IC(c) = log(n / n_c). A term
    reveals an entity if PMI >= disclosure * IC, that is n_ct >= n_t (n_c / n)^(1 - disclosure),
    and at least `contexts` different surroundings show both, so that copies of one passage
    are no evidence. Rows are counted, however many repeat an id.
    """
    n = found.count()
    rows = found.where(F.size("base") > 0).withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("base").alias("b"))
    held = rows.select("row", F.col("b.entity").alias("c")).distinct().groupBy("c").agg(F.count("*").alias("n_c"))
    around = F.array_distinct(F.concat(F.transform("b.around", _term), F.transform("b.around", _class_term)))
    near = rows.where(F.size("b.around") > 0).select("row", F.col("b.entity").alias("c"), F.xxhash64("b.around").alias("seen"), F.explode(around).alias("term"))
    # the surroundings are counted first: few pairs are left
    shown = near.select("c", "term", "seen").distinct().groupBy("c", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= contexts)
    together = split_join(near.select("c", "term", "row"), shown.select("c", "term"), ["c", "term"]).distinct().groupBy("c", "term").agg(F.count("*").alias("n_ct"))
    reveals = F.col("n_ct") >= F.col("n_t") * F.pow(F.col("n_c") / F.lit(float(n)), F.lit(1 - disclosure))
    pairs, drop_pairs = stored(together.join(held, "c"))
    # a term stands near some entity in no more rows than it stands in at all: pairs that fail by that alone are not counted
    least = near.select("term", "row").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    pairs, drop = stored(pairs.join(least, "term").where(reveals).drop("n_t"))
    drop_pairs()
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    classes = F.array_compact(F.array(*[F.when(F.rlike("text", F.lit(_HAS[c])), F.xxhash64(F.lit("class"), F.lit(c))) for c in CLASSES]))
    each = docs.select(F.explode(F.concat(F.array_distinct(F.transform(words, _term)), classes)).alias("term"))
    counts = _only(each, pairs.select("term").distinct()).groupBy("term").agg(F.count("*").alias("n_t")) if not pairs.isEmpty() else pairs.select("term", F.lit(1).alias("n_t"))
    out = cut(pairs.join(counts, "term").where(reveals).select("term").distinct())
    drop()
    return out


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(a, b, terms): for every row of docs (id, text) that has one of terms, the spans of those words."""
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    each = docs.select(_key().alias("key"), F.explode(F.array_distinct(F.transform(words, _term))).alias("term"))
    having = cut(_only(each, terms).select("key.a", "key.b").distinct())
    keyed = docs.select(_key().alias("key"), "text").select("key.a", "key.b", "text")
    having = F.broadcast(having) if having.count() <= BROADCAST_TERMS // 2 else having
    some = keyed.join(having, ["a", "b"], "left_semi").withColumn("words", words).withColumn("gaps", F.split("text", _WORD, -1)).withColumn("starts", F.expr(_starts("gaps", "words")))
    placed = F.zip_with("words", "starts", lambda w, s: F.struct(_term(w).alias("term"), s.alias("start"), (s + F.char_length(w)).alias("end"), _class_of(w).alias("class")))
    rows = _only(some.select("a", "b", F.explode(placed).alias("w")).select("a", "b", "w.*"), terms).drop("term").distinct()
    span = F.struct("start", F.lit(len(KINDS)).alias("order"), "end", F.lit(TERM).alias("kind"), "class")
    return rows.groupBy("a", "b").agg(F.collect_list(span).alias("terms"))


def _judged(docs: DataFrame, id_col: str, text_col: str, window: int, disclosure: float, contexts: int) -> tuple[DataFrame, DataFrame]:
    """The columns of personal_data with each row's key (a, b) and its spans with classes (all), and the terms that reveal."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = cut(_found(d, window).select("id", _key().alias("key"), "base").select("id", "key.a", "key.b", "base"))
    terms = disclosing_terms(found, d.select("text"), disclosure, contexts)
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit("").alias("class")))
    out = found.withColumn("base", plain)
    if terms.isEmpty():
        out = out.withColumn("all", F.col("base"))
    else:
        out = out.join(_term_spans(d, terms), ["a", "b"], "left")
        both = F.when(F.size("terms") > 0, F.array_sort(F.concat("base", "terms")))
        out = out.withColumn("both", both)
        order = len(KINDS)
        before = _running(f"transform(both, x -> if(x.order < {order}, x.end, -1))", "greatest($a, x)")
        after = _running(f"transform(reverse(both), x -> if(x.order < {order}, -x.start, -2147483647))", "greatest($a, x)")
        out = out.withColumn("before", F.when(F.col("both").isNotNull(), F.expr(before))).withColumn("after", F.when(F.col("both").isNotNull(), F.reverse(F.expr(after))))
        free = F.filter(F.arrays_zip("both", "before", "after"), lambda x: (x["both"]["order"] < order) | (x["before"] <= x["both"]["start"]) & (-x["after"] >= x["both"]["end"]))
        out = out.withColumn("all", F.coalesce(F.transform(free, lambda x: x["both"]), "base"))
    of = lambda k: F.filter("base", lambda s: s["kind"] == k)
    kinds = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    short = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return out.select("id", "a", "b", *kinds, short("base").alias("base"), short("all").alias("spans"), "all"), terms


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, disclosure: float = 0.95, contexts: int = 3) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans) for every row of docs.

    base lists the spans of the four kinds (start, end, kind) in code points, end exclusive,
    by start, then kind: for each kind the leftmost matches that do not overlap, without those
    that have a part above 255 (ip), not 12 to 19 digits that pass Luhn (card) or not 9 to 15
    digits (phone). spans has the words too that reveal an entity found anywhere in the corpus
    (disclosing_terms; an entity is an email, an address or a number, and its terms are the
    words up to `window` before and after it, as far as the next match of its kind), wherever
    they stand outside of base spans. Null texts are empty, ids may repeat or be null: each
    row is judged by its own text and counts as one document. Further columns are not read;
    an empty table gives no rows.

    Three passes over the texts: spans with the words around them; the counts of the words
    that stand near one entity in enough surroundings; the places of those that reveal. Words
    are shuffled as hashes, after they met those terms; texts only where so many hold a
    revealing word that their keys are not broadcast.
    """
    out, _ = _judged(docs, id_col, text_col, window, disclosure, contexts)
    return out.drop("a", "b", "all")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, disclosure: float = 0.95, contexts: int = 3) -> DataFrame:
    """docs with text_col without what personal_data finds.

    A base span becomes [kind]. A word that reveals is generalised to its class, [number],
    [name] or [word], or removed where that class reveals an entity as well. What overlaps is
    replaced once. Texts without spans stay as they are, null ones too. Names that begin with
    __pd_ are taken.
    """
    out, terms = _judged(docs, id_col, text_col, window, disclosure, contexts)
    removed = [c for c in CLASSES if not terms.where(F.col("term") == F.xxhash64(F.lit("class"), F.lit(c))).isEmpty()]
    spans = out.where(F.size("all") > 0).groupBy("a", "b").agg(F.first("all").alias("__pd_all")).select(F.struct("a", "b").alias("__pd_key"), "__pd_all")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__pd_key", F.struct(F.xxhash64(F.col(id_col), text).alias("a"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("b")))
    d = keyed.join(spans, "__pd_key", "left").drop("__pd_key")
    # pieces of the text are cut from short chunks, so that a long one isn't gone through for every span
    d = d.withColumn("__pd_chunks", F.when(F.col("__pd_all").isNotNull(), F.regexp_extract_all(text_col, F.lit("(?s).{1,%d}" % _PIECE), F.lit(0))))
    d = d.withColumn("__pd_ends", F.when(F.col("__pd_all").isNotNull(), F.expr(_running("transform(__pd_all, x -> x.end)", "greatest($a, x)"))))

    def piece(begin: Column, end: Column) -> Column:
        first = F.floor(begin / _PIECE).cast("int")
        some = F.array_join(F.slice("__pd_chunks", first + 1, F.floor(end / _PIECE).cast("int") - first + 1), "")
        return F.when(end > begin, F.substring(some, begin - first * _PIECE + 1, end - begin)).otherwise("")

    last = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("__pd_ends", i - 1))
    gone = F.array(*map(F.lit, removed)).cast("array<string>")
    label = lambda x: F.when(x["class"] == "", F.concat(F.lit("["), x["kind"], F.lit("]"))).when(F.array_contains(gone, x["class"]), "").otherwise(F.concat(F.lit("["), x["class"], F.lit("]")))
    parts = F.transform("__pd_all", lambda x, i: F.concat(piece(last(i), x["start"]), F.when(x["start"] >= last(i), label(x)).otherwise("")))
    tail = piece(F.element_at("__pd_ends", -1), F.char_length(text_col))
    return d.withColumn(text_col, F.when(F.col("__pd_all").isNotNull(), F.concat(F.array_join(parts, ""), tail)).otherwise(F.col(text_col))).drop("__pd_all", "__pd_chunks", "__pd_ends")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
