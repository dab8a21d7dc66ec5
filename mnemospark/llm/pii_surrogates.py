"""Personal data replaced by keyed surrogates of the same kind, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import digest, durable, let

_TITLES_F = r"Mrs|Ms|Miss|Madame|Mme|Frau|Señora|Sra"
_TITLES_M = r"Mr|Monsieur|Herr|Señor|Sr"
_INTRO = r"[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo"
#: Without the s of a possessive.
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}(?<!['’]s)"
#: A name by itself, where no title stands before it.
_ALONE = rf"(?<![\p{{L}}\p{{N}}_'’-]){_NAME}(?![\p{{L}}\p{{N}}_])"
_SECRET = r"(?i:password|passwd|secret|token|api[_-]?key)[ \t]{0,3}[:=][ \t]{0,3}[\"']?"

#: Groups of three and four; (555)123-4567; pairs of digits; Spanish groups; an area with 6 to 8 digits; any international form.
_PHONE = (
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    r"(?:\+[0-9]{1,3}[ .-]?(?:\(0\)[ ]?)?|0)[0-9](?:[ .-][0-9]{2}){4}(?![0-9])",
    r"(?:[6-9][0-9]{2}[ .-]|9[0-9][ .-][0-9])[0-9]{2}(?:[ .-][0-9]{2}){2}(?![0-9])",
    r"(?:\+[0-9]{1,3}[ .-]?(?:\(0\)[ ]?)?|0)[0-9]{1,4}(?:[ .-]| ?/ ?)[0-9]{6,8}(?:-[0-9]{1,4})?(?![0-9])",
    r"\+[0-9](?:[ .()/-]{0,2}[0-9]){7,14}(?![0-9])",
)
#: What each kind looks like; the first that matches at a place wins. Each begins where no ASCII letter or digit stands before.
#: Unbounded repetition is of single character classes only: the matcher recurses on repeated groups, and a long text would end its stack.
KINDS: dict[str, str] = {
    "secret": _SECRET + r"[A-Za-z0-9/+_=-]{8,}",
    "email": r"(?<![._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "access_key": r"AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": "|".join(_PHONE),
    "woman": rf"(?:{_TITLES_F})\.?[ ]{_NAME}(?: {_NAME})?",
    "man": rf"(?:{_TITLES_M})\.?[ ]{_NAME}(?: {_NAME})?",
    "person": rf"(?:{_INTRO})[ ]{_NAME}(?: {_NAME})?",
}
#: The first characters of each group tell most words apart before any alternative is tried.
_GROUPS = {"[PpSsTtAa]": ("secret",), "[0-9]": ("ip", "card", "ssn", "phone"), "[+(]": ("phone",), "[A-Z]": ("access_key", "iban", "woman", "man")}
PATTERN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?={at})(?:{'|'.join(KINDS[k] for k in kinds)})" for at, kinds in _GROUPS.items()) + f"|{KINDS['email']}|{KINDS['person']})"


def _suspect(text: Column) -> Column:
    """True for every text that ``PATTERN`` may match: it has a digit, a sign of an address or secret, or a title."""
    words = [w for group in (_TITLES_F, _TITLES_M) for w in group.split("|")] + ["AKIA", "ame is", "ame ist", "heiße", "appelle", "llamo"]
    return reduce(lambda rest, w: rest | F.contains(text, F.lit(f"{w}")), words, F.rlike(text, F.lit("[0-9@=:]")))


#: Names and secrets keep the words in front of them.
_LEAD = {"secret": _SECRET, "woman": rf"(?:{_TITLES_F})\.?[ ]", "man": rf"(?:{_TITLES_M})\.?[ ]", "person": rf"(?:{_INTRO})[ ]"}
_DIGITS_ONLY = ("card", "ssn", "phone")
_NAMES = ("woman", "man", "person")
#: Draws before a surrogate is made longer instead, where a format has hardly any values left.
_ATTEMPTS = 12


def kind_of(mention: Column) -> Column:
    return reduce(lambda rest, k: F.when(F.rlike(mention, F.lit(f"^(?:{KINDS[k]})$")), F.lit(k)).otherwise(rest), reversed(KINDS), F.lit("person"))


def _by_kind(kind: Column, kinds: tuple[str, ...]) -> Column:
    return kind.isin(*kinds)


def _parts(kind: Column, mention: Column) -> Column:
    """Struct of ``lead``, which stays, and ``values``: the entities in the mention (the parts of a name, else one)."""
    lead = reduce(lambda rest, k: F.when(kind == k, F.regexp_extract(mention, f"^{_LEAD[k]}", 0)).otherwise(rest), _LEAD, F.lit(""))

    def split(lead: Column) -> Column:
        body = F.substr(mention, F.length(lead) + 1)
        names = F.split(body, " ")
        # The first of two names is a given name and has the gender; a lone one is a surname.
        return F.struct(lead.alias("lead"), F.when(_by_kind(kind, _NAMES), names).otherwise(F.array(body)).alias("values"))

    return let(lead, split)


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common: digits of numbers, else lower case; secrets as they are."""
    return (
        F.when(_by_kind(kind, _DIGITS_ONLY), F.regexp_replace(value, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(_by_kind(kind, ("secret", "access_key", "ip")), value)
        .otherwise(F.lower(value))
    )


def _luhn(digits: Column) -> Column:
    """Sum whose multiple of ten makes a card number valid."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda total, i: total + let(F.substr(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)),
    )


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """A keyed stand-in of the canonical ``value``: letters for letters of the same case and script, digits for
    digits, everything else kept; names are speakable and end by gender, networks, country codes and top-level
    domains stay, octets are octets, and a valid card number stays valid."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(8)])

    # Bound once: inside the loop over characters an outer expression would be evaluated for each of them.
    fixed = F.when(kind == "email", F.length(F.regexp_extract(value, r"\.[A-Za-z]+$", 0))).otherwise(0)
    facts = F.struct(stream.alias("s"), F.length(value).alias("n"), fixed.alias("fixed"), F.rlike(value, F.lit("^[0-9a-f]+$")).alias("is_hex"))

    def make(known: Column) -> Column:
        s, n, fixed, is_hex = (known[c] for c in ("s", "n", "fixed", "is_hex"))
        draw = lambda i: F.conv(F.substr(s, (i % 128) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        pick = lambda letters, n: F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
        kept = F.when(kind == "access_key", 4).when(kind == "iban", 2).when(kind == "card", 1).when((kind == "phone") & (n > 10), n - 10).when((kind == "phone") & F.startswith(value, F.lit("0")), 1).otherwise(0)
        woman, last = kind == "woman_given", lambda i: i == n - 1
        named = F.startswith(kind, F.lit("name")) | F.endswith(kind, F.lit("_given"))

        def at(c: Column, i: Column) -> Column:
            even = i % 2 == 0
            latin = F.when(named & woman & last(i), F.lit("a")).when(named & (kind == "man_given") & last(i), pick("nrkt", draw(i))).when(
                named, F.when(even, pick("bdfghklmnprstvz", draw(i))).otherwise(pick("aeiou", draw(i)))
            ).otherwise(F.when((kind == "secret") & is_hex, pick("0123456789abcdef", draw(i))).otherwise(pick("abcdefghijklmnopqrstuvwxyz", draw(i))))
            cyrillic = F.when(named & woman & last(i), F.lit("а")).when(named & (kind == "man_given") & last(i), pick("нркт", draw(i))).when(even, pick("бвгдзклмнпрст", draw(i))).otherwise(pick("аеиоу", draw(i)))
            greek = F.when(even, pick("βγδκλμνπρτ", draw(i))).otherwise(pick("αειου", draw(i)))
            new = (
                F.when(F.rlike(c, F.lit("[0-9]")), F.when((kind == "secret") & is_hex, pick("0123456789abcdef", draw(i))).otherwise(pick("0123456789", draw(i))))
                .when(F.rlike(c, F.lit("[a-zß-ÿ]")), latin)
                .when(F.rlike(c, F.lit("[A-ZÀ-Þ]")), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", draw(i)))
                .when(F.rlike(c, F.lit(r"\p{IsCyrillic}")), cyrillic)
                .when(F.rlike(c, F.lit(r"\p{IsGreek}")), greek)
                .when(F.rlike(c, F.lit(r"\p{L}")), F.when(named, F.when(even, pick("bdfgklmnprst", draw(i))).otherwise(pick("aeiou", draw(i)))).otherwise(pick("abcdefghijklmnopqrstuvwxyz", draw(i))))
                .otherwise(c)
            )
            return F.when((i < kept) | (i >= n - fixed), c).otherwise(new)

        plain = F.array_join(F.transform(F.split(value, ""), at), "")
        octets = F.concat_ws(".", *[(draw(F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
        valid = F.when((kind == "card") & (_luhn(value) % 10 == 0), let(
            plain, lambda p: let(F.concat(F.substr(p, F.lit(1), n - 1), F.lit("0")), lambda z: F.concat(F.substr(z, F.lit(1), n - 1), ((10 - _luhn(z) % 10) % 10).cast("string")))
        )).otherwise(plain)
        made = F.when(kind == "ip", octets).when(kind == "card", valid).otherwise(plain)
        # A format without room is given up for distinctness.
        return F.when(attempt < _ATTEMPTS, made).otherwise(F.when(_by_kind(kind, _DIGITS_ONLY), F.concat(made, F.conv(F.substr(s, F.lit(1), F.lit(12)), 16, 10))).otherwise(F.concat(made, F.substr(s, F.lit(1), F.lit(12)))))

    return let(facts, make)


def poured(kind: Column, mention: Column, new: Column) -> Column:
    """``new`` in the format of the mention: its separators and its case."""
    n = F.length(mention)
    count = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), F.lit("[^0-9A-Za-z]"), F.lit("")))
    chars = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substr(mention, i, F.lit(1)), lambda c: F.when(F.rlike(c, F.lit("[0-9A-Za-z]")), F.substr(new, count(i), F.lit(1))).otherwise(c)))
    spaced = F.concat(F.array_join(chars, ""), F.substr(new, F.length(F.regexp_replace(mention, "[^0-9A-Za-z]", "")) + 1))
    cased = F.array_join(F.zip_with(F.split(new, ""), F.split(mention, ""), lambda c, m: F.when(F.rlike(m, F.lit(r"\p{Lu}")), F.upper(c)).otherwise(c)), "")
    return F.when(_by_kind(kind, (*_DIGITS_ONLY, "iban")), spaced).when(_by_kind(kind, ("secret", "access_key", "ip")), new).otherwise(cased)


def _again(piece: Column, names: Column) -> Column:
    """``piece`` with every further mention of the document's ``names`` (lower case to surrogate) replaced."""

    def swap(word: Column) -> Column:
        return let(F.try_element_at(names, F.lower(word)), lambda new: F.when(new.isNull(), word).otherwise(poured(F.lit("name"), word, new)))

    words = F.transform(F.regexp_extract_all(piece, F.lit(_ALONE), F.lit(0)), swap)
    gaps = F.split(piece, _ALONE, -1)
    return let(gaps, lambda g: F.concat(F.array_join(F.zip_with(F.slice(g, 1, F.size(g) - 1), words, lambda gap, word: F.concat(gap, word)), ""), F.element_at(g, -1)))


def _entity_kind(kind: Column, size: Column, pos: Column) -> Column:
    """Given names go by gender; surnames are one kind, whoever bears them."""
    given = F.when(kind == "woman", F.lit("woman_given")).when(kind == "man", F.lit("man_given")).otherwise(F.lit("name_given"))
    return F.when(_by_kind(kind, _NAMES), F.when((size > 1) & (pos == 0), given).otherwise(F.lit("name"))).otherwise(kind)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, new) for distinct (kind, value): surrogates that no two entities share and no entity has.

    Entities whose draw is taken, by another entity or by a real value, draw again. A round keeps to the rows that
    collided; what is settled is only joined with their draws.
    """
    settled, waiting, attempt = None, durable(entities.withColumn("attempt", F.lit(0))), 0
    while True:
        drawn = waiting.withColumn("new", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
        drawn = drawn.withColumn("turn", F.row_number().over(W.partitionBy("kind", "new").orderBy("value")))
        real = entities.select(F.col("kind").alias("k"), F.col("value").alias("taken"))
        taken = real if settled is None else real.unionByName(settled.select(F.col("kind").alias("k"), F.col("new").alias("taken"))).distinct()
        checked = durable(drawn.join(taken, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("taken")), "left"))
        free = (F.col("turn") == 1) & F.col("taken").isNull()
        done = checked.filter(free).select("kind", "value", "new")
        settled = done if settled is None else settled.unionByName(done)
        waiting = checked.filter(~free).select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        attempt += 1
        if waiting.isEmpty():
            return settled
        if attempt > _ATTEMPTS + 4:
            raise RuntimeError("no distinct surrogates are left")


def replace(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """Rows of ``docs`` as ``row`` with surrogates in ``text``, beside ``n_entities``.

    Only texts with a mention are hashed, joined and rebuilt; all others pass straight through. An entity
    (canonical value) has the same surrogate in every document. Spans are detected by ``KINDS``; a name is found
    where a title or an introduction stands before it, and then every capitalised whole-word mention of it in that
    document counts (where it is a given name and a surname, as the first). A frequent entity is spread by skew splitting. Null and
    empty texts stay as they are, repeated rows are replaced alike, extra columns ride along inside ``row``. An empty
    table gives an empty one. Of alternatives at one place the first kind wins, and of equal draws the smaller value
    keeps its own. Work is linear in the length of a text, however long a run of letters, dots or digits it has.
    """
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row.text")
    matches = lambda t: F.coalesce(_suspect(t) & F.rlike(t, F.lit(PATTERN)), F.lit(False))
    there = matches(text)
    h1, h2 = digest(F.col("text"))
    mentions = durable(
        docs.select("text").filter(matches(F.col("text")))
        .select(h1.alias("h1"), h2.alias("h2"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("mentions")).dropDuplicates(["h1", "h2"])
    )
    kind = kind_of(F.col("mention"))
    single = (
        mentions.select("h1", "h2", F.posexplode("mentions").alias("at", "mention"))
        .select("h1", "h2", "at", "mention", F.explode(F.array(kind)).alias("kind"))
        .select("h1", "h2", "at", "kind", F.explode(F.array(_parts(F.col("kind"), F.col("mention")))).alias("p"))
        .select("h1", "h2", "at", "kind", F.col("p.lead").alias("lead"), F.size("p.values").alias("parts"), F.posexplode("p.values").alias("pos", "part"))
        .withColumn("entity", _entity_kind(F.col("kind"), F.col("parts"), F.col("pos")))
        .withColumn("value", canonical(F.col("entity"), F.col("part")))
    )
    single = durable(single)
    known = assign(single.select(F.col("entity").alias("kind"), "value").distinct(), key)
    known = known.select(F.col("kind").alias("e_kind"), F.col("value").alias("e_value"), "new")
    spoken = single.join(known, (F.col("entity") == F.col("e_kind")) & (F.col("value") == F.col("e_value")))
    first = spoken.filter(_by_kind(F.col("kind"), _NAMES)).groupBy("h1", "h2", "value").agg(F.min_by("new", F.struct("at", "pos")).alias("new"))
    names = first.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("value", "new"))).alias("names")).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), "names")
    spoken = spoken.select("h1", "h2", "at", "pos", "lead", poured(F.col("kind"), F.col("part"), F.col("new")).alias("new"))
    whole = spoken.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("at", "pos", "lead", "new"))).alias("news")).select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), "news")
    whole = whole.join(names, (F.col("m1") == F.col("n1")) & (F.col("m2") == F.col("n2")), "left").drop("n1", "n2")

    r1, r2 = digest(text)
    touched = rows.filter(there).withColumn("h1", r1).withColumn("h2", r2).join(whole, (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2")))
    names = F.col("names")

    def rebuild(pieces: Column) -> Column:
        more = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.size(F.filter(F.regexp_extract_all(p, F.lit(_ALONE), F.lit(0)), lambda w: F.map_contains_key(names, F.lower(w)))))
        spared = F.when(names.isNull(), pieces).otherwise(F.transform(pieces, lambda p: _again(p, names)))
        n = F.size(F.filter("news", lambda m: m["pos"] == 0)) + F.when(names.isNull(), F.lit(0)).otherwise(more)

        def joined(kept: Column) -> Column:
            # A name's second part follows a blank; every other part opens the next mention, behind the piece before it.
            opened = F.transform("news", lambda m: F.when(m["pos"] == 0, F.concat(F.get(kept, m["at"]), m["lead"], m["new"])).otherwise(F.concat(F.lit(" "), m["new"])))
            return F.struct(F.concat(F.array_join(opened, ""), F.element_at(kept, -1)).alias("text"), n.cast("long").alias("n"))

        return let(spared, joined)

    # Bound inside one expression: the struct that rides along must not pass a generator (its fields are pruned there).
    done = touched.select("row", let(F.split(text, PATTERN, -1), rebuild).alias("done"))
    changed = done.select(F.col("row").withField("text", F.col("done.text")).alias("row"), F.col("done.n").alias("n_entities"))
    return rows.filter(~there).select("row", F.lit(0).cast("long").alias("n_entities")).unionByName(changed)
