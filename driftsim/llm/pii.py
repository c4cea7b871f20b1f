"""Personal data, and the terms around it that give it away (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftsim.session import durable

#: The kinds of personal data, in order, and their patterns. Loops are
#: possessive where what follows cannot be part of them: the matches are the same, and no
#: text makes the matcher go back over it. An e-mail begins where a run of its letters does,
#: an address where a run of digits does.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
#: A word: a letter, and the letters and marks that follow it.
WORD = r"\p{L}[\p{L}\p{M}]++"
#: A term gives an entity away if it stood in at least SUPPORT different texts that hold
#: the entity, the entity has at least this share of the term's texts, and knowing the term
#: makes the entity likelier by this many bits.
SUPPORT, SHARE, BITS = 3, 0.5, 4.0


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Numbers of one part of a running total.
PART = 256


def _running(values: Column, combine) -> Column:
    """array<int>: for each value the total of those before it, 0 for the first.

    ``combine`` adds or takes the larger; values are not negative. Parts have their own
    totals, which are carried over from part to part, so that arrays that grow one by one
    stay short.
    """
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, value: Column) -> Column:
        return F.struct(combine(state["at"], value).alias("at"), F.concat(state["found"], F.array(state["at"])).alias("found"))

    def carried(parts: Column) -> Column:
        before = F.aggregate(F.transform(parts, lambda p: p["at"]), none, step, lambda state: state["found"])
        return F.flatten(
            F.transform(
                F.arrays_zip(parts.alias("part"), before.alias("before")),
                lambda z: F.transform(z["part"]["found"], lambda x: combine(z["before"], x)),
            )
        )

    def body(values: Column) -> Column:
        number = F.floor((F.size(values) - 1) / PART).cast("int")
        begins = F.transform(F.sequence(F.lit(0), F.greatest(number, F.lit(0))), lambda n: n * PART + 1)
        return _let(F.transform(begins, lambda begin: F.aggregate(F.slice(values, begin, F.lit(PART)), none, step)), carried)

    return _let(values, body)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, pattern: str) -> Column:
    """array<(start, end, value)> of the leftmost non-overlapping matches, in code points.

    The texts between matches and the matches take turns; their lengths add up to places.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pairs: Column) -> Column:
        at = _running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["hit"])), _sum)

        def place(z: Column) -> Column:
            start = z["at"] + F.length(z["pair"]["gap"])
            end = start + F.length(z["pair"]["hit"])
            return F.struct(start.alias("start"), end.alias("end"), z["pair"]["hit"].alias("value"))

        return F.transform(F.arrays_zip(pairs.alias("pair"), at.alias("at")), place)

    return _let(_let(hits, lambda found: F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, pair: Column) -> Column:
        return total + pair

    def weigh(c: Column, i: Column) -> Column:
        twice = c.try_cast("int") * (1 + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    letters = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    return F.aggregate(F.transform(letters, weigh), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _worth(kind: str, text: Column) -> Column:
    """A cheap condition without which a text holds no match."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][ -]?[0-9]")


def _no_spans() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int>>")


def base_spans(text: Column) -> Column:
    """array<(kind, start, end)> of all personal data in a text, by kind and place."""
    return F.concat(*[_spans_of(kind, text) for kind in KINDS])


def _spans_of(kind: str, text: Column) -> Column:
    found = F.filter(_matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    named = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return F.when(_worth(kind, text), named).otherwise(_no_spans())


def _merged(spans: Column) -> Column:
    """array<(start, end)>: the places under any span, overlapping ones as one, in order.

    A span that starts where all before it have ended begins a new place, which ends where
    the last of those before the next one does.
    """
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def merged(spans: Column) -> Column:
        before = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
        rows = F.arrays_zip(spans.alias("span"), before.alias("before"))
        begins = F.filter(rows, lambda r: (r["before"] <= r["span"]["start"]))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))

        def place(pair: Column) -> Column:
            return F.struct(pair["begin"]["span"]["start"].alias("start"), F.coalesce(pair["next"]["before"], pair["last"]).alias("end"))

        def paired(begins: Column) -> Column:
            following = F.slice(begins, F.lit(2), F.greatest(F.size(begins) - 1, F.lit(0)))
            return F.transform(
                F.arrays_zip(begins.alias("begin"), following.alias("next"), F.array_repeat(last, F.size(begins)).alias("last")), place
            )

        return F.when(F.size(spans) > 0, _let(begins, paired)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    return _let(plain, merged)


def _blanks(n: Column) -> Column:
    return F.repeat(F.lit(" "), n)


def _outside(text: Column, places: Column) -> Column:
    """The text with blanks for protected places and for words that run into one; the rest stays where it is."""

    def piece(i: Column) -> Column:
        last, place = F.when(i > 0, F.get(places, i - 1)), F.get(places, i)
        start, end = F.coalesce(last["end"], F.lit(0)), F.coalesce(place["start"], F.length(text))
        between = F.substring(text, start + 1, end - start)
        runs_on = F.substring(text, last["end"], F.lit(1)).rlike("[A-Za-z]")
        head = F.when(runs_on, F.regexp_extract(between, r"^[\p{L}\p{M}]++", 0)).otherwise("")
        rest = F.substring(between, F.length(head) + 1, F.length(between))
        runs_in = F.substring(text, place["start"] + 1, F.lit(1)).rlike("[A-Za-z]")
        tail = F.when(runs_in, F.regexp_extract(rest, r"(?<![\p{L}\p{M}])[\p{L}\p{M}]++\z", 0)).otherwise("")
        kept = F.substring(rest, F.lit(1), F.length(rest) - F.length(tail))
        hidden = F.length(tail) + F.coalesce(place["end"] - place["start"], F.lit(0))
        return F.concat(_blanks(F.length(head)), kept, _blanks(hidden))

    cut = F.array_join(F.transform(F.sequence(F.lit(0), F.size(places)), piece), "")
    return F.when(F.size(places) > 0, cut).otherwise(text)


def _terms(text: Column) -> Column:
    """array<string>: the different words of a text in small letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _term_spans(text: Column, terms: Column) -> Column:
    """array<(kind, start, end)>: every place where one of ``terms`` stands as a word of the text.

    The text is drawn with x for the letters of these words and blanks for all others, so
    that only what is found is walked through.
    """

    def drawn(word: Column) -> Column:
        return F.repeat(F.when(F.array_contains(terms, F.lower(word)), "x").otherwise(" "), F.length(word))

    gaps, words = F.split(text, WORD, -1), F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), drawn)
    pairs = F.arrays_zip(gaps.alias("gaps"), words.alias("words"))
    drawing = F.array_join(F.transform(pairs, lambda p: F.concat(_blanks(F.length(p["gaps"])), F.coalesce(p["words"], F.lit("")))), "")
    return F.transform(_matches(drawing, "x+"), lambda m: F.struct(F.lit(TERM).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _documents_of_terms(marked: DataFrame, held: DataFrame) -> DataFrame:
    """(term, with_term): in how many documents of the whole corpus each term stands.

    A text with protected places has fewer terms than words; those it lacks are taken off
    again, so that no text has to meet another. Terms in fewer than SUPPORT are left out.
    """
    words = marked.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    hidden = held.select("copies", F.explode(F.array_except(_terms(F.col("text")), _terms(F.col("outside")))).alias("term"))
    less = hidden.groupBy("term").agg((-F.sum("copies")).alias("n"))
    summed = words.unionByName(less).groupBy("term").agg(F.sum("n").alias("with_term"))
    return durable(summed.filter(F.col("with_term") >= SUPPORT))


def _entities(text: Column, places: Column) -> Column:
    """array<string>: what stands in the protected places, in small letters, each once."""
    return F.array_distinct(F.transform(places, lambda p: F.lower(F.substring(text, p["start"] + 1, p["end"] - p["start"]))))


def disclosing(held: DataFrame, holders: DataFrame, of_term: DataFrame, documents: int) -> DataFrame:
    """(entity, term) pairs in which the term gives the entity away.

    ``held`` (print, copies, outside) has each text with protected places once, ``holders``
    (print, copies, entity) whose they are, ``of_term`` (term, with_term) the documents of
    each term, of ``documents`` in all. Copies are documents, but support comes from
    different texts. Entities in fewer than SUPPORT texts, or in so many documents that no
    term can gain BITS, are left out before rows meet: no pair of theirs can be found. The
    sums are made in parts, so that neither a frequent entity nor a frequent term is a hot
    group.
    """
    of_entity = holders.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("with_entity"))
    able = durable(of_entity.filter((F.col("texts") >= SUPPORT) & (F.log2(documents / F.col("with_entity")) >= BITS)))
    asked = durable(holders.join(able, "entity").select("print", "copies", "entity"))
    rows = held.select("print", _terms(F.col("outside")).alias("terms")).join(asked, "print").select("entity", "copies", F.explode("terms").alias("term"))
    sums = rows.groupBy("entity", "term").agg(F.count("*").alias("support"), F.sum("copies").alias("both"))
    found = sums.filter(F.col("support") >= SUPPORT).join(of_term, "term").filter(F.col("both") >= SHARE * F.col("with_term"))
    gain = F.log2(F.col("both") / F.col("with_term") * documents / F.col("with_entity"))
    return durable(found.join(able, "entity").filter(gain >= BITS).select("entity", "term"))


def find_personal_data(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(document, base, spans) for every row of ``docs`` (doc_id, text, ...).

    ``base`` is array<(kind, start, end)> of the four kinds, ``spans`` is the same and
    every occurrence of a term that gives a protected place of the document away, kind
    TERM; places are code points, ends exclusive. The context of a place is its whole
    document: all words but those in protected places. The share and gain of a term are
    estimated over all documents of the corpus, those without personal data included (see
    ``disclosing``). A null text is empty; a null doc_id is a document like any other;
    rows that are there twice get the same result; ``document`` is the input row as a
    struct, so columns of any name pass through; with ``keep`` it has these columns only,
    and the others, such as the text, are not shuffled. The patterns take time in
    proportion to a text's length, and its matches are placed by running totals, so a very
    long text, or one of very many places, is worked through in one row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select(F.md5(text.cast("binary")).alias("print"), text.alias("text"))
    spanned = marked.select("print", "text", base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
    # The places are found once, and each text that holds some is written once.
    once = spanned.groupBy("print").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count("*").alias("copies"))
    placed = once.withColumn("places", _merged(F.col("spans")))
    held = durable(placed.withColumn("outside", _outside(F.col("text"), F.col("places"))))
    holders = durable(held.select("print", "copies", F.explode(_entities(F.col("text"), F.col("places"))).alias("entity")))
    pairs = disclosing(held, holders, _documents_of_terms(marked, held), docs.count())
    gone = durable(holders.join(pairs, "entity").groupBy("print").agg(F.collect_set("term").alias("terms")))
    terms = F.when(F.col("terms").isNotNull(), _term_spans(F.col("outside"), F.col("terms"))).otherwise(_no_spans())
    found = durable(held.join(gone, "print", "left").select("print", F.col("spans").alias("base"), F.concat("spans", terms).alias("spans")))
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct("*")
    met = docs.select(row.alias("document"), F.md5(text.cast("binary")).alias("print")).join(found, "print", "left")
    return met.select("document", F.coalesce("base", _no_spans()).alias("base"), F.coalesce("spans", _no_spans()).alias("spans"))


def count_of(kind: str, spans: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_list(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every protected place generalised to <PRIVATE>, overlapping spans as one."""
    places = _merged(spans)
    text = F.coalesce(text, F.lit(""))

    def piece(i: Column) -> Column:
        start = F.coalesce(F.when(i > 0, F.get(places, i - 1)["end"]), F.lit(0))
        end = F.coalesce(F.get(places, i)["start"], F.length(text))
        return F.substring(text, start + 1, end - start)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(places)), piece), "<PRIVATE>")
