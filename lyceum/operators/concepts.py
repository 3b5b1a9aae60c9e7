"""What a document teaches: teaching sentences, what each is about, the terms they name, and the concepts these make.

Everything about one sentence is column expressions over the arrays of its words, so finding terms needs no shuffle.
Concepts are aggregated by document and name; names that mean the same are folded together by equi-joins on stems
and on the prefixes of names, never by comparing all names of a document in pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.functions import words
from lyceum.operators.records import name_stem
from lyceum.sources.shared import stored

_OPEN, _CLOSE = "\u0001", "\u0002"
#: Sentences that are kept as evidence of a concept.
EVIDENCE = 3


def sentences(docs: DataFrame, lines_per_page: int = 4) -> DataFrame:
    """doc_id, page, ord, number, sentence: sentences of texts (doc_id, text) by page, a page being so many lines.

    ord rises through a document, and neighbours on a page differ by one; number counts a document's sentences
    from 0. Null texts have none.
    """
    lines = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / lines_per_page).cast("int")), lambda p: F.array_join(F.slice(lines, p * lines_per_page + 1, F.lit(lines_per_page)), "\n"))
    placed = lambda page, p: F.transform(fn.sentences(page), lambda s, k: F.struct((p + 1).alias("page"), ((p + 1).cast("long") * 1_000_000 + k).alias("ord"), s.alias("sentence")))
    found = docs.filter("text is not null").select("doc_id", F.posexplode(F.flatten(F.transform(pages, placed))).alias("number", "s"))
    return found.select("doc_id", "s.page", "s.ord", "number", "s.sentence")


def layout_detail(text: Column) -> Column:
    """Whether a text is about the design of a page."""
    return text.rlike(words.LAYOUT_BEGUN) & text.rlike(words.LAYOUT)


def _furnished_raw(text: Column) -> Column:
    """Whether a text shows furniture as it stands; what each kind can't be without is looked for first."""
    raw = "|".join(f"(?:{p})" for _, p in words.RAW_FURNITURE)
    maybe = F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")) | F.contains(text, F.lit("10.")) | (F.octet_length(text) > F.length(text)) & text.rlike("[©®™Ⓒⓒ]") | text.rlike(r"(?i)www\.|is[bs]n")
    return maybe & text.rlike(raw)


def _furnished(plain: Column) -> Column:
    """Whether a normal text shows furniture of any kind: what begins at a word's start is looked for there alone."""
    every = [a for _, p in words.FURNITURE for a in fn.alternatives(p)]
    starts = "|".join(a[2:] for a in every if a.startswith(r"\b"))
    anywhere = lambda ascii: reduce(lambda a, b: a | b, [plain.rlike(a) for a in every if not a.startswith(r"\b") and a.isascii() == ascii])
    return plain.rlike(rf"\b(?:{starts})") | anywhere(True) | (~fn.latin_only(plain) & anywhere(False))


def teaching_sentences(rows: DataFrame) -> DataFrame:
    """Of rows (sentence) those that assert something that can be taught, with content: its distinct content words.

    At least 25 characters and five content words, no heading, furniture or page design. Null sentences go.
    """
    long = rows.filter((F.length("sentence") >= 25) & ~layout_detail(F.col("sentence")) & ~_furnished_raw(F.col("sentence")))
    # Texts without Arabic marks have one normal form, with marks or without.
    marked = (F.octet_length("sentence") > F.length("sentence")) & F.col("sentence").rlike("[\u064b-\u065f\u0670\u0640]")
    content = lambda plain: F.when(~_furnished(plain), F.array_distinct(F.when(marked, fn.content_tokens(F.col("sentence"))).otherwise(fn.content_of(plain))))
    # The filter stands inside a generator, as Spark would work out the content twice for one behind it.
    full = F.filter(F.transform(F.array(fn.normal(F.col("sentence"), strip_marks=False)), content), lambda x: F.size(x) >= 5)
    rows = long.select("*", F.explode(full).alias("content"))
    # A heading has an open end, a number or a name in front, or capitals only: what has none of these needs no closer look.
    s = F.trim("sentence")
    maybe = ~s.rlike(r"[.!?؟:;]$") | s.rlike(r"^\d") | s.rlike(words.NAMED_HEADING) | s.rlike(r"^[^a-z]+$")
    return rows.filter(~F.when(maybe, fn.heading_like(F.col("sentence"))).otherwise(False))


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, r"(?U)[^\w؀-ۿ]", "")


#: A word in the shape of a verb in -s or -ed: Latin letters, small first, four at least.
_VERB = r"[a-z][A-Za-z]{2,}(?:[sS]|[eE][dD])"


def finite_verb(word: Column) -> Column:
    """Whether a word has the shape of a verb."""
    return _bare(word).rlike(f"^{_VERB}$")


def _predicate_after(text: Column) -> Column:
    """Whether the first word of a text that decides it, a mark or a word that opens a clause apart, is a predicate."""
    plain = F.regexp_replace(text, r"[^\p{L}\p{N}_\s,;:.]", "")
    either = lambda values: "|".join(values)
    decides = rf"(?:^|\s)(?:\S*[,;:.]\S*|(?i:{either(words.SUBORDINATORS)})(?=\s|$)|((?i:{either(words.PREDICATE_STOP)})|{_VERB})(?=\s|$))"
    return F.regexp_extract(plain, decides, 1) != ""


#: What the words of a span have besides letters and digits: marks, and blanks that only Unicode knows.
_INSIDE = "'’-\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _span(raw: Column, after: Column) -> Column:
    """A span: its words, each with what it may be in a clause, and the text behind it.

    raw has Latin words of letters, digits, hyphens and apostrophes, or Arabic ones. next: what a word says of
    whether a predicate follows: 1 yes, 2 no, 0 nothing.
    """

    def bare(w: Column) -> Column:
        b = F.translate(w, _INSIDE, "")
        return F.struct(w.alias("w"), b.alias("b"), F.lower(b).alias("low"))

    def classed(x: Column) -> Column:
        stop, sub, verb = x["low"].isin(words.PREDICATE_STOP), x["low"].isin(words.SUBORDINATORS), x["b"].rlike(f"^{_VERB}$")
        return F.struct(x["w"].alias("w"), stop.alias("stop"), sub.alias("sub"), verb.alias("verb"))

    def told(x: Column) -> Column:
        follows = F.when(x["sub"], "2").when(x["stop"] | x["verb"], "1").otherwise("0")
        return F.struct(x["w"].alias("w"), x["stop"].alias("stop"), x["sub"].alias("sub"), x["verb"].alias("verb"), follows.alias("next"))

    ours = F.transform(F.transform(F.transform(F.filter(F.split(raw, r"\s+"), lambda w: w != ""), bare), classed), told)
    return F.struct(ours.alias("words"), after.alias("after"))


def _marked(span: Column) -> Column:
    """A span with codes, what its words say of a predicate, and upto, the words before the first that opens a clause, unless a predicate comes first."""
    marks = F.array_join(F.transform(span["words"], lambda w: F.when(w["stop"], "s").when(w["sub"], "c").otherwise(".")), "")
    return F.struct(
        span["words"].alias("words"), span["after"].alias("after"), F.array_join(F.transform(span["words"], lambda w: w["next"]), "").alias("codes"),
        F.length(F.regexp_extract(marks, r"^(.\.*)c", 1)).alias("upto"),
    )


def _until_clause(span: Column) -> Column:
    """A marked span up to the first word that opens a clause, unless a predicate comes first; nothing comes after it then.

    goes_on: whether a predicate follows behind the span; that is asked of a verb only behind which no word decides it.
    """
    cut = span["upto"] > 0
    asked = ~cut & F.coalesce(F.get(span["words"], F.length(F.regexp_replace(span["codes"], "0+$", "")) - 1)["verb"], F.lit(False))
    return F.struct(
        F.when(cut, F.slice(span["words"], F.lit(1), span["upto"])).otherwise(span["words"]).alias("words"),
        F.when(cut, "").otherwise(F.regexp_extract(span["after"], r"^\s*(\S*)", 1)).alias("behind"),
        F.when(asked, _predicate_after(span["after"])).otherwise(False).alias("goes_on"),
        F.when(cut, F.substr(span["codes"], F.lit(1), span["upto"])).otherwise(span["codes"]).alias("codes"),
    )


def _name(span: Column) -> Column:
    """The name that a span begins with: up to its predicate, without circumstances and stranded adverbs.

    A word ends the name if it is a known predicate or opens a clause, or, behind the first word, if it has the
    shape of a verb and what comes next shows that it is one: a complement, nothing, or words of which none is a
    predicate. A plain word between a verb-shaped one and a complement, or between two capitalised ones, is a verb too.
    """
    upper = lambda w: w.rlike(r"^\p{Lu}")

    def ends(i: Column) -> Column:
        w, before = F.get(span["words"], i), F.get(span["words"], i - 1)
        after = F.coalesce(F.get(span["words"], i + 1)["w"], span["behind"])
        more, opens = after != "", F.lower(after).isin(words.COMPLEMENT_OPENERS)
        first = F.regexp_extract(F.substr(span["codes"], i + 2), "^0*(.)", 1)
        predicate = F.when(first == "", span["goes_on"]).otherwise(first == "1")
        plain = ~w["verb"] & ((opens & before["verb"]) | (upper(before["w"]) & upper(after))) & ~upper(w["w"])
        noun = F.translate(w["w"], _INSIDE, "").rlike(words.NOUN_ENDING)
        verb = w["verb"] & (opens | (~more & ~noun) | (more & ~predicate))
        return F.coalesce(w["stop"] | ((i > 0) & (w["sub"] | plain | verb)), F.lit(False))

    n = F.size(span["words"])
    at = F.get(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), ends), F.lit(0))
    return F.array_join(F.transform(F.slice(span["words"], F.lit(1), F.coalesce(at, n)), lambda w: w["w"]), " ")


def _tidy(name: Column) -> Column:
    last = lambda x: F.trim(F.regexp_replace(x, rf"(?i)(?:^|\s+){words.CIRCUMSTANCE}$", ""))
    short = F.regexp_replace(name, rf"(?iU)(?:\s+{words.STRANDED}(?=\s|$))+$", "")
    # What the first two take off has a blank before or in it.
    return F.when(F.contains(name, F.lit(" ")), last(F.regexp_replace(short, rf"(?i)(?:(?:^|\s+){words.CIRCUMSTANCE}\s+\S+)+$", ""))).otherwise(last(name))


def _weighed(term: Column) -> Column:
    """A phrase with what decides whether it can be a name."""
    bare = F.regexp_replace(term, words.LEADING_DETERMINER, "")
    return fn.once(bare, lambda b: F.struct(term.alias("term"), b.alias("bare"), fn.content_tokens(b).alias("tokens")))


def _acceptable(x: Column) -> Column:
    """Whether a weighed phrase (term, bare, tokens) can be the name of a concept."""
    barred = "|".join(f"(?:{p})" for p in (words.DISCOURSE_OPENER, *words.NO_NAME))
    first = F.coalesce(F.get(x["tokens"], F.lit(0)), F.lit(""))
    stems = sorted({_stem(w) for w in words.CONTAINERS})
    graded = first.isin(words.EVALUATIVE) & F.forall(F.slice(x["tokens"], 2, 99), lambda t: t.isin(words.CONTAINERS))
    empty = (first == "") | first.isin(words.NO_HEAD) | F.forall(x["tokens"], lambda t: t.isin(words.NO_CONCEPT)) | F.forall(x["tokens"], lambda t: name_stem(t).isin(stems))
    return (F.length(x["bare"]) > 2) & (F.length(x["bare"]) <= 70) & ~x["bare"].rlike(barred) & ~empty & ~graded


def _stem(word: str) -> str:
    """records.name_stem for the words of a list."""
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("ses", "xes", "zes", "ches", "shes")) and len(word) > 4:
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def _defined(sentence: Column) -> Column:
    """Spans (raw, after) that stand where a definition has its term, form by form, in order."""

    def of(term: str, behind: str, before: str) -> Column:
        marked = F.regexp_replace(sentence, rf"(?U){before}({term})({behind})", f"$1{_OPEN}$2{_CLOSE}$3")

        def spans(parts: Column) -> Column:
            n = F.size(parts)
            rest = lambda i: F.regexp_replace(F.array_join(F.slice(parts, i, n), ""), _CLOSE, "")
            raw = lambda i: F.substring_index(F.get(parts, i - 1), _CLOSE, 1)
            at = F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: i <= n)
            return F.transform(at, lambda i: F.struct(raw(i).alias("raw"), F.substr(rest(i), F.length(raw(i)) + 1).alias("after")))

        # What stands behind a term is looked for alone first, and the marked text is made once.
        none = F.slice(F.array(F.struct(F.lit("").alias("raw"), F.lit("").alias("after"))), 1, 0)
        return F.when(sentence.rlike(f"(?U){behind}"), fn.once(F.split(marked, _OPEN), spans)).otherwise(none)

    return F.concat(*[of(words.TERM, b, r"\b(The\s+|A\s+|An\s+)?") for b in words.DEFINING], of(*words.DEFINING_AR, "()"))


def with_terms(rows: DataFrame) -> DataFrame:
    """rows (sentence) with subject and terms.

    subject: the noun phrase at the head of the sentence (at most five words), behind a leading subordinate
    clause, adverb or discourse opener; '' if there is none. terms: array of (term, type) that the sentence
    names: those that it defines, else its subject if that can be a name, with the kind of knowledge of the
    sentence. Sentences that don't begin with a capital name nothing; correlatives (the more ..., the less ...)
    have no subject to name. Null sentences have subject '' and no terms.
    """
    s = F.replace(F.replace(F.trim(F.coalesce("sentence", F.lit(""))), F.lit(_OPEN), F.lit("")), F.lit(_CLOSE), F.lit(""))
    opened = F.regexp_replace(F.regexp_replace(s, words.LEADING_SUBORDINATE, ""), words.LEADING_ADVERB, "")
    opened = F.trim(F.regexp_replace(opened, words.DISCOURSE_OPENER, ""))
    # The head is matched once: what it leaves is behind it, and a determiner before the subject goes.
    head = F.regexp_extract(opened, rf"(?U)^(?:The\s+|A\s+|An\s+)?{words.SUBJECT}\b", 0)
    rows = rows.withColumn("__s", s).withColumn("__opened", F.struct(opened.alias("text"), head.alias("head")))
    behind = F.when(F.col("__opened.head") == "", "").otherwise(F.substr("__opened.text", F.length("__opened.head") + 1))
    fallback = F.struct(F.regexp_replace("__opened.head", r"(?U)^(?:The|A|An)\s+", "").alias("raw"), behind.alias("after"))
    defines = F.col("__s").rlike(r"^[A-Z؀-ۿ]") & fn.found(F.col("__s"), r"\s(?:is|are)\s+(?:defined|the|a|an|called|known)|\srefers?\s+to|هو|هي")
    rows = rows.withColumn("__spans", F.concat(F.array(fallback), F.when(defines, _defined(F.col("__s"))).otherwise(F.slice(F.array(fallback), 1, 0))))
    bare = lambda x: F.trim(F.regexp_replace(F.trim(x), words.LEADING_DETERMINER, ""))
    rows = rows.withColumn("__spans", F.transform("__spans", lambda x: _span(bare(x["raw"]), x["after"])))
    rows = rows.withColumn("__spans", F.transform(F.transform("__spans", _marked), _until_clause))
    # The first name is the subject's, the others those of definitions.
    rows = rows.withColumn("__names", F.transform(F.transform("__spans", lambda x: _tidy(_name(x))), _weighed))
    rows = rows.withColumns({"subject": F.get("__names", F.lit(0))["term"], "__good": F.transform("__names", lambda x: F.struct(x["term"].alias("term"), _acceptable(x).alias("ok")))})
    rows = rows.withColumn("__defined", F.filter(F.slice("__good", 2, 9_999), lambda x: x["ok"]))
    own = F.col("__s").rlike(r"^[A-Z؀-ۿ]") & ~F.col("__s").rlike(words.CORRELATIVE) & F.get("__good", F.lit(0))["ok"]
    term = lambda t, kind: F.struct(t.alias("term"), kind.alias("type"))
    some = F.when(F.size("__defined") > 0, F.transform("__defined", lambda x: term(x["term"], F.lit("definition")))).when(own, F.array(term(F.col("subject"), fn.knowledge_type(F.col("__s")))))
    return rows.withColumn("terms", F.coalesce(some, F.array().cast("array<struct<term:string,type:string>>"))).drop("__s", "__opened", "__spans", "__names", "__good", "__defined")


def subjects(rows: DataFrame) -> DataFrame:
    """doc_id, page, ord, subject, carried: what each sentence (doc_id, page, ord, sentence) is about.

    carried: for a sentence that begins with a pronoun or `the process` and the like, the subject of the sentence
    before it on the page, else null.
    """
    found = with_terms(rows).select("doc_id", "page", "ord", "subject", F.coalesce(F.col("sentence").rlike(words.ANAPHORIC), F.lit(False)).alias("refers"))
    before = Window.partitionBy("doc_id", "page").orderBy("ord")
    last = F.when(F.lag("ord").over(before) == F.col("ord") - 1, F.lag("subject").over(before))
    return found.select("doc_id", "page", "ord", "subject", F.when(F.col("refers") & (last != ""), last).alias("carried"))


def _name_key(name: Column) -> Column:
    return F.filter(F.transform(F.split(name, r"\s+"), lambda w: name_stem(F.lower(_bare(w)))), lambda w: w != "")


def candidates(rows: DataFrame) -> DataFrame:
    """doc_id, key, name, first, types, evidence: names that terms of rows (doc_id, page, ord, sentence, terms) have, by their normal form.

    evidence: array of (ord, place, page, text), text being a hash, so that no table of names carries sentences.
    """
    named = rows.select("doc_id", "page", "ord", "sentence", F.posexplode("terms").alias("place", "t")).select("doc_id", "page", "ord", "place", "sentence", "t.*")
    named = named.withColumn("key", fn.normal(F.col("term"))).filter(F.length("key") >= 3)
    named = named.filter(~fn.generic_label(F.col("term")) & ~layout_detail(F.col("term")) & ~_furnished_raw(F.col("term")) & ~_furnished(fn.normal(F.col("term"), strip_marks=False)))
    proof = F.struct("ord", "place", "page", F.xxhash64("sentence").alias("text"))
    return named.groupBy("doc_id", "key").agg(
        F.min_by("term", F.struct("ord", "place")).alias("name"), F.min(F.struct("ord", "place")).alias("first"),
        F.collect_list("type").alias("types"), F.slice(F.array_sort(F.collect_list(proof)), 1, EVIDENCE).alias("evidence"),
    )


def _folded(entries: DataFrame, into: DataFrame) -> DataFrame:
    """entries with those that `into` (doc_id, key, target) names folded into their targets.

    A target keeps its name and own evidence, then takes the types of the others and, while it has less than
    three, their evidence, in the order in which they first stood. A target that is folded itself stays as well,
    with what it was given, and hands that on if it came first.
    """
    moved = stored(into.filter("key <> target").select("doc_id", "key", "target"), "moved")
    targets = moved.select("doc_id", F.col("target").alias("key"))
    concerned = moved.select("doc_id", "key").union(targets).distinct()
    # Most names are concerned by nothing and pass by; the rest are few.
    few = stored(entries.join(concerned, ["doc_id", "key"], "left_semi").select(entries.columns), "folding")
    part = F.struct(F.col("first").alias("at"), F.col("types").alias("types"), F.col("evidence").alias("evidence"))
    gone = moved.join(few.select("doc_id", "key", "first", "types", "evidence"), ["doc_id", "key"])
    onward = gone.select("doc_id", F.col("key").alias("via"), F.col("first").alias("via_first"), "target").join(gone.select("doc_id", F.col("target").alias("via"), "first", "types", "evidence"), ["doc_id", "via"]).filter("first < via_first")
    given = gone.select("doc_id", F.col("target").alias("key"), part.alias("p")).union(onward.select("doc_id", F.col("target").alias("key"), F.struct(F.col("via_first").alias("at"), F.col("types"), F.col("evidence")).alias("p")))
    given = given.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("p")).alias("given"))
    left = few.join(moved.join(targets.distinct(), ["doc_id", "key"], "left_anti").select("doc_id", "key"), ["doc_id", "key"], "left_anti").join(given, ["doc_id", "key"], "left")
    some = F.coalesce("given", F.slice(F.array(part), 1, 0))
    # Own evidence stays as it is, repeats included; what is added differs from all that stands.
    more = F.aggregate(F.flatten(F.transform(some, lambda p: p["evidence"])), F.col("evidence"), lambda kept, p: F.when((F.size(kept) >= EVIDENCE) | F.exists(kept, lambda k: k["text"] == p["text"]), kept).otherwise(F.concat(kept, F.array(p))))
    folded = left.select("doc_id", "key", "name", "first", F.concat("types", F.flatten(F.transform(some, lambda p: p["types"]))).alias("types"), more.alias("evidence"))
    return entries.join(concerned, ["doc_id", "key"], "left_anti").select(folded.columns).union(folded)


def prefix_targets(entries: DataFrame) -> DataFrame:
    """doc_id, key, target: names (doc_id, key, name, first) that only say something about another name of the document.

    A longer name goes to the longest other name that it begins with (by stems), if the words behind have a verb
    among them: `ionic bonds differ` to `ionic bond`, but not `cell theory` to `cell`. A single word that is the
    last of exactly one longer name goes to that: `plan` to `Schlieffen Plan`. Of names with equal stems the
    last stands for all. Prefixes meet by an equi-join, at most one row for each word of a name.
    """
    # Stems are worked out once. verb: the number of the last word of a name that has the shape of a verb.
    verb = F.array_max(F.transform(F.split("name", r"\s+"), lambda w, i: F.when(finite_verb(w), i + 1).otherwise(0)))
    named = stored(entries.select("doc_id", "key", "first", _name_key(F.col("name")).alias("stems"), verb.alias("verb")), "stems").filter(F.size("stems") > 0)
    last = named.groupBy("doc_id", "stems").agg(F.max_by("key", "first").alias("owner"))
    heads = named.filter(F.size("stems") > 1).select("doc_id", F.array(F.element_at("stems", -1)).alias("stems"), F.col("key").alias("long"))
    single = named.filter(F.size("stems") == 1)
    only = single.join(heads, ["doc_id", "stems"]).groupBy("doc_id", "stems").agg(F.count_distinct("long").alias("n"), F.max("long").alias("long")).filter("n = 1").select("doc_id", "stems", "long")
    index = last.join(only, ["doc_id", "stems"], "left").select("doc_id", "stems", F.coalesce("long", "owner").alias("target"))
    alone = single.join(index, ["doc_id", "stems"]).select("doc_id", "key", "target")
    # A width has a verb behind it up to the last verb, which stands behind the first word.
    most = F.least(F.size("stems"), F.col("verb")) - 1
    widths = named.filter((F.size("stems") > 1) & (F.col("verb") > 1)).select("doc_id", "key", "stems", F.explode(F.sequence(F.lit(1), most)).alias("width"))
    met = widths.select("doc_id", "key", "width", F.slice("stems", F.lit(1), F.col("width")).alias("stems")).join(index, ["doc_id", "stems"]).filter("key <> target")
    longer = met.groupBy("doc_id", "key").agg(F.max_by("target", "width").alias("target"))
    return alone.filter("key <> target").union(longer)


def declared_aliases(rows: DataFrame) -> DataFrame:
    """doc_id, full, alias: pairs of names (in normal form) that sentences declare to be the same: `A (B)`, `A, known as B`."""
    pattern = "(?U)" + words.ALIAS
    # The pattern tries sixty ends from every letter: what stands behind the first name is looked for before it.
    declares = F.col("sentence").rlike("(?U)" + words.ALIAS_DECLARED) & F.col("sentence").rlike(pattern)
    take = lambda k: F.regexp_extract_all("sentence", F.lit(pattern), F.lit(k))
    zipped = F.arrays_zip(take(1).alias("full"), take(2).alias("short"), take(3).alias("other"))
    pairs = rows.filter(declares).select("doc_id", F.explode(zipped).alias("z"))
    found = pairs.select("doc_id", fn.normal(F.col("z.full")).alias("full"), fn.normal(F.when(F.col("z.short") != "", F.col("z.short")).otherwise(F.col("z.other"))).alias("alias"))
    return found.filter("full <> '' and alias <> '' and full <> alias").distinct()


def alias_targets(entries: DataFrame, declared: DataFrame, rows: DataFrame, steps: int = 4) -> DataFrame:
    """doc_id, key, target: names (doc_id, key, name, first, evidence) that are aliases of another name of the document.

    Declared aliases (doc_id, full, alias) count if both are names. A name that another begins with is an alias of
    the shortest such, if the words behind are containers (`method`, `model`) or stand in three names of the
    document at least, and no sentence (doc_id, ord, sentence) of its evidence defines the shorter one itself.
    Chains are followed for `steps` steps.
    """
    said = entries.select("doc_id", F.col("key").alias("alias")).join(declared, ["doc_id", "alias"]).join(entries.select("doc_id", F.col("key").alias("full")), ["doc_id", "full"])
    said = said.groupBy("doc_id", F.col("alias").alias("key")).agg(F.max("full").alias("target"))
    split = stored(entries.select("doc_id", "key", "first", fn.content_tokens(F.col("key")).alias("tokens")), "split").filter(F.size("tokens") > 0)
    counted = split.select("doc_id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n")).filter("n >= 3")
    common = counted.groupBy("doc_id").agg(F.collect_set("token").alias("common"))
    heads = split.select("doc_id", F.col("key").alias("long"), F.col("first").alias("long_first"), "tokens").withColumn("width", F.explode(F.sequence(F.lit(1), F.size("tokens")))).filter(F.col("width") < F.size("tokens"))
    heads = heads.select("doc_id", "long", "long_first", F.slice("tokens", F.lit(1), F.col("width")).alias("tokens"), F.slice("tokens", F.col("width") + 1, F.size("tokens")).alias("extra"))
    heads = heads.join(common, "doc_id", "left")
    generic = F.forall("extra", lambda x: x.isin(words.CONTAINERS)) | F.forall("extra", lambda x: F.coalesce(F.array_contains("common", x), F.lit(False)))
    met = stored(split.select("doc_id", "key", "tokens").join(heads.filter(generic).select("doc_id", "long", "long_first", "tokens"), ["doc_id", "tokens"]).filter("key <> long").select("doc_id", "key", "long", "long_first"), "longer-names")
    own = F.concat(F.lit(r"(?iU)\b(?:the\s+|a\s+|an\s+)?\Q"), F.trim("name"), F.lit(r"\E\b\s+(?:is|are)\s+(?:defined\s+as|the\s|a\s|an\s)"))
    asked = met.select("doc_id", "key").distinct().join(entries.select("doc_id", "key", "name", F.explode("evidence").alias("e")), ["doc_id", "key"]).select("doc_id", "key", "name", "e.ord")
    defined = asked.join(rows.select("doc_id", "ord", "sentence"), ["doc_id", "ord"]).filter(F.rlike("sentence", own)).select("doc_id", "key").distinct()
    implied = met.join(defined, ["doc_id", "key"], "left_anti").groupBy("doc_id", "key").agg(F.min(F.struct(F.length("long").alias("n"), "long_first", "long"))["long"].alias("target"))
    first = stored(said.union(implied.join(said, ["doc_id", "key"], "left_anti")), "aliases")
    found = first
    for _ in range(steps):
        onward = first.select("doc_id", F.col("key").alias("target"), F.col("target").alias("further"))
        found = found.join(onward, ["doc_id", "target"], "left").select("doc_id", "key", F.coalesce("further", "target").alias("target"))
    return found.filter("key <> target")


def _supported(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """entries with the evidence of sentences that name nothing themselves but are about one of them.

    A sentence is about a name if its subject has all words of the name and else only grammatical ones: then both
    are equal without those, and meet by an equi-join. A correlative is about the names in its first half.
    """
    silent = rows.filter(F.size("terms") == 0).select("doc_id", "page", "ord", "sentence", "subject")
    key = lambda t: F.array_sort(F.array_except(t, F.array(*map(F.lit, words.GRAMMATICAL))))
    names = entries.select("doc_id", "key", "name", F.array_distinct(fn.content_tokens(F.col("name"))).alias("tokens")).filter(F.size("tokens") > 0)
    half = F.lower(F.substring_index("sentence", ",", 1))
    compares = F.col("sentence").rlike(words.CORRELATIVE)
    direct = silent.filter(~compares & (F.col("subject") != "")).withColumn("stated", F.array_distinct(fn.content_tokens(F.col("subject"))))
    proof = F.struct("ord", F.lit(0).alias("place"), "page", F.xxhash64("sentence").alias("text")).alias("proof")
    met = direct.withColumn("k", key(F.col("stated"))).join(names.withColumn("k", key(F.col("tokens"))), ["doc_id", "k"]).filter(F.size(F.array_except("tokens", "stated")) == 0).select("doc_id", "key", proof)
    inside = silent.filter(compares).withColumn("half", half).join(names, "doc_id").filter(F.contains("half", F.lower("name"))).select("doc_id", "key", proof)
    more = met.union(inside).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("proof")).alias("more"))
    joined = entries.join(more, ["doc_id", "key"], "left")
    add = lambda kept, p: F.when((F.size(kept) >= EVIDENCE) | F.exists(kept, lambda k: k["text"] == p["text"]), kept).otherwise(F.concat(kept, F.array(p)))
    return joined.withColumn("evidence", F.when(F.col("more").isNull(), F.col("evidence")).otherwise(F.aggregate(F.coalesce("more", F.slice("evidence", 1, 0)), F.col("evidence"), add))).drop("more")


def taught(rows: DataFrame, content: bool = False) -> DataFrame:
    """The teaching sentences among rows, with subject and terms, written as a table; content: with their distinct content words as well."""
    found = teaching_sentences(rows)
    return stored(with_terms(found if content else found.drop("content")), "taught")


def concepts(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, concept, key, type, types, pages, evidence: what the sentences (doc_id, page, ord, sentence) of documents teach.

    Teaching sentences name terms; terms of one normal form are a concept with up to three sentences as evidence.
    Names that only say something about another fold into it, sentences that name nothing support the name that
    they are about, and aliases fold last. type: of the types seen, that of the highest worth, then the most
    frequent, then the last by name. A document without teaching sentences has no concepts; rows with a null
    sentence count for nothing. known: taught(rows), if it is there already. What several steps read is written as
    a table of the shared folder first, sentences once. evidence: array of (ord, place, page, text), text being a
    hash of the sentence at ord.
    """
    known = taught(rows) if known is None else known
    entries = stored(candidates(known), "candidates")
    entries = stored(_folded(entries, prefix_targets(entries)), "prefixes")
    entries = stored(_supported(entries, known), "supported")
    entries = _folded(entries, alias_targets(entries, declared_aliases(rows), known))
    kinds = F.transform(F.array_distinct("types"), lambda k: F.struct(worth(k).alias("worth"), F.size(F.filter("types", lambda t: t == k)).alias("n"), k.alias("type")))
    return entries.select("doc_id", F.col("name").alias("concept"), "key", F.array_max(kinds)["type"].alias("type"), "types", F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["page"]))).alias("pages"), "evidence")


def worth(kind: Column) -> Column:
    """What a kind of knowledge is worth to a quiz."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.KNOWLEDGE_VALUE.items() for x in pair]), kind)
