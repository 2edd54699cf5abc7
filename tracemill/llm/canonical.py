"""Mapping free-entered values to the entries of a reference list.

A prefix-filter set-similarity join: every spelling becomes a set of character
tokens, tokens are ordered by global rarity, only the rare prefixes are joined,
length and positional filters drop pairs that can't be similar enough, Jaccard
is verified exactly, and the best entry is kept.

What is joined are readings of the values (the whole, its parts, its last and
first words) with spellings of the entries: their own names, abbreviations and
stems made by rule, words of their gloss, and names out of a thesaurus, an
input table. The edits that part a reading from a spelling, how much of the
value was read and how the spelling came about decide which is best.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.thesaurus import default_names
from tracemill.session import materialise

#: Fields that node_entries maps.
FIELDS = ["equipment_class", "valve_type", "instrument_function"]
#: Edits that may part a reading from the longest spellings.
MOST_EDITS = 2
#: What an edit, a partial reading and a derived spelling cost; the least sum wins.
EDIT, PART, TURNED, LAST, FIRST = 1.5, 1.0, 0.5, 2.0, 3.0
KINDS = {"name": 0.0, "stem": 0.5, "head": 1.0, "short": 1.0, "other": 2.0, "gloss": 4.0}
#: Which kind keeps a spelling that several entries have.
DIRECT = ["name", "other", "head", "stem", "short", "gloss"]

# Words that say nothing about what a value means, and numbers as words.
SMALL_WORDS = ["no", "nr", "num", "of", "for", "the", "and", "by", "de", "del", "la", "der", "die", "das", "und", "y", "in", "on", "with", "to"]
_SMALL = frozenset(SMALL_WORDS)
NUMBER_WORDS = {"1": "one", "2": "two", "3": "three", "4": "four"}
#: Signs of stems, so that they only meet stems.
_STEM = "~"


def plain(value: Column) -> Column:
    """Lower case without accents, apostrophes and quotes; underscores are blanks."""
    x = F.regexp_replace(F.lower(value), "ß", "ss")
    x = F.translate(x, "äöüáàâéèêíìîóòôúùûñç_", "aouaaaeeeiiiooouuunc ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "['\"`’´]", ""), r"\s+", " "))


_ENDING = re.compile("(?<=...)(ing|ers?|ors?)$")
_PARTS = re.compile(r"[,;()\[\]]|\s-\s")
_ABOUT = re.compile(r"^(.+?) (?:for|of) (.+)$")
_WORD = re.compile(r"[^\W_]+")
_NUMBERED = re.compile(r"(?<![^\W_])[1-4](?![^\W_])")


def stem(word: str) -> str:
    """A word without the endings that make nouns and participles of verbs; words of a short stem as they are."""
    return _ENDING.sub("", word)


def read_value(text: str, nouns: frozenset[str], longest: int) -> dict[str, float]:
    """Keys and their costs: the ways to read a plain value.

    The whole; what commas, brackets and dashes part; 'b, a' and 'b for a' as
    'a b'; of each the last words and the first words. Words of one letter,
    numbers and small words count for nothing, `nouns` (what every value of the
    field is) neither if others are left. longest: characters that a key has
    at most to match anything, so that many words of it are looked at.
    """
    most, out = longest // 2 + 1, {}
    parts = [p.strip() for p in _PARTS.split(text) if p.strip()]
    texts = [(text, 0.0)]
    if len(parts) > 1:
        texts += [(f"{b} {a}", TURNED) for a, b in zip(parts, parts[1:])] + [(p, PART) for p in parts]
    for t, cost in list(texts):
        if _NUMBERED.search(t):
            texts.append((_NUMBERED.sub(lambda m: NUMBER_WORDS[m[0]], t), cost))
        if m := _ABOUT.match(t):
            texts.append((f"{m[2]} {m[1]}", cost + TURNED))

    def put(key: str, cost: float) -> None:
        if 0 < len(key) <= longest and cost < out.get(key, 99.0):
            out[key] = cost

    for t, cost in texts:
        every = [w for w in _WORD.findall(t) if len(w) > 1 and not w[0].isdigit() and w not in _SMALL]
        held = [w for w in every if w not in nouns] or every
        n = len(held)
        for words in (held, every):
            if len(words) <= longest:
                put("".join(words), cost)
        for k in range(1, min(n - 1, most) + 1):
            put("".join(held[n - k :]), cost + LAST)
            put("".join(held[:k]), cost + FIRST)
        if n <= most:  # a stem stands for one word; the words of long texts are no values
            for w in held:
                put(stem(w) + _STEM, cost + (FIRST if n > 1 else 0.0))
    return out


def readings(values: DataFrame, nouns: dict[str, list[str]], longest: int) -> DataFrame:
    """field_name, value, key, cost: the ways to read each value (field_name, value), as compact keys (`read_value`). nouns: by field."""
    held = {f: frozenset(words) for f, words in nouns.items()}

    def read(batches):
        for b in batches:
            rows = [(f, v, k, c) for f, v, t in zip(b.field_name, b.value, b.text) for k, c in read_value(t, held.get(f, frozenset()), longest).items()]
            yield pd.DataFrame(rows, columns=["field_name", "value", "key", "cost"])

    return values.select("field_name", "value", plain(F.col("value")).alias("text")).mapInPandas(read, "field_name string, value string, key string, cost double")


_VOWELS = re.compile("(?<=.)[aeiou]")
_TWICE = re.compile(r"(.)\1")


def short_forms(words: list[str]) -> set[str]:
    """Abbreviations of a name by rule: vowels left out, words cut to their first letters, initials of three or more words."""
    forms = []
    for w in words:
        bare = _TWICE.sub(r"\1", _VOWELS.sub("", w))
        forms.append([w, *([bare] if 1 < len(bare) < len(w) else []), *(w[:n] for n in range(2 if len(words) == 1 else 3, min(len(w), 7)))])
    if len(words) == 1:
        return set(forms[0][1:])
    out = {"".join(f[1] if k == j and len(f) > 1 else f[0] for k, f in enumerate(forms)) for j in range(len(words))}
    out |= {"".join(words[:j] + [f] + words[j + 1 :]) for j in range(len(words)) for f in forms[j][1:]}
    out.add("".join(f[1] if len(f) > 1 else f[0] for f in forms))
    if len(words) > 2:
        out.add("".join(w[0] for w in words))
    return out - {"".join(words)}


SPELLINGS = "field_name string, canonical string, entry_key string, kind string"


def spellings(canonical: DataFrame, names: DataFrame) -> DataFrame:
    """field_name, canonical, entry_key, kind: every spelling of every entry of the list.

    canonical: field_name, canonical, gloss; names: field_name, canonical, name
    (those of no entry are left out). Of entries that share a spelling those
    with the more direct kind keep it; shared abbreviations, heads, stems and
    gloss words mean none of them.
    """
    known = canonical.filter("field_name is not null and canonical is not null").groupBy("field_name", "canonical").agg(F.max("gloss").alias("gloss"))
    more = names.groupBy("field_name", "canonical").agg(F.collect_set("name").alias("names"))

    def spell(batches):
        for b in batches:
            rows = []
            for field, entry, own, gloss, others in zip(b.field_name, b.canonical, b.own, b.gloss_words, b.names):
                words = [w for w in re.split(r"[\W_]+", own) if w]
                put = lambda key, kind, f=field, e=entry: rows.append((f, e, key, kind)) if key else None
                put("".join(words), "name")
                put("".join(words) + "s", "name")
                if len(words) == 1:
                    put(stem(words[0]) + _STEM, "stem")
                if len(words) > 1:
                    put(words[-1], "head")
                for s in short_forms(words) if words else ():
                    put(s, "short")
                for name in others if others is not None else ():
                    held = [w for w in re.split(r"[\W_]+", name.lower()) if w]
                    for form in {"".join(held), re.sub("(?<=[aou])e(?=[^aeiou])", "", "".join(held))}:
                        put(form, "other")
                    put("".join(w for w in held if w not in SMALL_WORDS), "other")
                    put("".join(w for w in held if w != re.split(r"[\W_]+", field.lower())[0]), "other")
                    if len(held) > 2:
                        put("".join(w[0] for w in held), "short")
                for w in gloss_words(gloss):
                    put(w, "gloss")
            yield pd.DataFrame(rows, columns=["field_name", "canonical", "entry_key", "kind"])

    joined = known.join(more, ["field_name", "canonical"], "left").select("field_name", "canonical", plain(F.col("canonical")).alias("own"), plain(F.coalesce("gloss", F.lit(""))).alias("gloss_words"), "names")
    rank = F.array_position(F.array(*[F.lit(k) for k in DIRECT]), F.col("kind"))
    rows = joined.mapInPandas(spell, SPELLINGS).withColumn("rank", rank)
    best = rows.withColumn("least", F.min("rank").over(W.partitionBy("field_name", "entry_key"))).filter("rank = least")
    best = best.withColumn("owners", F.size(F.collect_set("canonical").over(W.partitionBy("field_name", "entry_key"))))
    return best.filter((F.col("owners") == 1) | F.col("kind").isin("name", "other")).select("field_name", "canonical", "entry_key", "kind").distinct()


def gloss_words(gloss: str) -> list[str]:
    """Words of a gloss of four letters or more."""
    return [w for w in re.split(r"[\W_]+", gloss) if len(w) > 3 and w not in SMALL_WORDS]


def kind_cost(kind: Column) -> Column:
    return reduce(lambda c, k: c.when(kind == k, F.lit(KINDS[k])), KINDS, F.when(F.lit(False), F.lit(0.0)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def token_set(keys: pd.Series) -> pd.Series:
    """Tokens of compact keys: letters and padded pairs, each with its occurrence number, so that the set keeps counts."""
    return pd.Series([_tokens(k) for k in keys])


def _tokens(key: str | None) -> list[str]:
    if not key:
        return []
    padded, seen, out = f"^{key}$", {}, []
    for t in [*key, *(padded[i : i + 2] for i in range(len(key) + 1))]:
        seen[t] = seen.get(t, 0) + 1
        out.append(f"{t}#{seen[t]}")
    return out


def edits(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and swaps of neighbours between two keys, exact up to MOST_EDITS.

    A letter may also be dropped and its neighbours swapped, or the other way round.
    """
    cut = lambda k, i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k)))
    meets = lambda k, other: F.exists(F.sequence(F.lit(1), F.length(k)), lambda i: F.exists(F.sequence(F.lit(1), F.length(k) - 2), lambda j: swap(cut(k, i), j) == other))
    swap = lambda k, i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.lit(1)), F.substring(k, i, F.lit(1)), F.substring(k, i + 2, F.length(k)))
    at = F.sequence(F.lit(1), F.length(a) - 1)
    plain_ = F.levenshtein(a, b)
    one = F.array_min(F.transform(at, lambda i: F.levenshtein(swap(a, i), b) + 1))
    two = F.array_min(F.transform(at, lambda i: F.array_min(F.transform(at, lambda j: F.levenshtein(swap(swap(a, i), j), b) + 2))))
    gone = F.when((plain_ == 3) & (F.length(a) == F.length(b) + 1) & (F.length(a) > 2), meets(a, b)).when((plain_ == 3) & (F.length(b) == F.length(a) + 1) & (F.length(b) > 2), meets(b, a))
    return F.when((plain_ <= 1) | (F.length(a) < 2), plain_).when(F.coalesce(gone, F.lit(False)), 2).when(plain_ == 2, F.least(plain_, one)).when(plain_ <= 4, F.least(plain_, one, two)).otherwise(plain_)


def allowed_edits(length: Column, partial: Column) -> Column:
    """Edits that may part a key from a spelling of this length; fewer if the key is but some words of the value."""
    whole = F.when(length <= 3, 0).when(length <= 5, 1).otherwise(MOST_EDITS)
    return F.when(partial, F.when(length <= 3, 0).when(length <= 7, 1).otherwise(MOST_EDITS)).otherwise(whole)


#: Lengths up to which the least Jaccard is told apart.
_LENGTHS = 64


def _edits_of(length: int) -> int:
    return 0 if length <= 3 else 1 if length <= 5 else MOST_EDITS


def least_jaccard() -> tuple[list[float], list[float]]:
    """By the length of a key, and of a spelling: what the token sets of any two that may match have in common at least.

    An edit takes three tokens of the longer one at most; abbreviations of
    three letters or more may lack one more letter.
    """
    keys, entries = [1.0] * (_LENGTHS + 1), [1.0] * (_LENGTHS + 1)
    for n in range(1, _LENGTHS + 1):
        for m in range(max(1, n - MOST_EDITS), n + MOST_EDITS + 1):
            e = max(_edits_of(min(m, n + 1)), int(m == n + 1 and m > 2))
            if abs(n - m) <= e:
                same = 2 * max(n, m) + 1 - 3 * e
                j = max(same, 1) / (2 * n + 2 * m + 2 - max(same, 1))
                keys[n] = min(keys[n], j)
                if m <= _LENGTHS:
                    entries[m] = min(entries[m], j)
    return keys, entries


def _prefixed(rows: DataFrame, rarity: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its tokens in order of rarity, one line per token of its prefix: token, at (place from 0), size, least, tokens."""
    ordered = (
        rows.select(*keys, "least", F.explode("tokens").alias("token"))
        .join(rarity, "token")
        .groupBy(*keys, "least")
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
        .withColumn("tokens", F.col("ranked.token"))
    )
    size = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), (size - F.ceil(size * F.col("least") - 1e-9) + 1).cast("int"))
    return ordered.select(*keys, "least", size.alias("size"), "tokens", F.posexplode(prefix).alias("at", "token"))


def similar_entries(values: DataFrame, entries: DataFrame, least: float | None = None) -> DataFrame:
    """field_name, key, entry_key, jaccard of all pairs with Jaccard >= least, each once.

    values: field_name, key; entries: field_name, entry_key (of both distinct
    ones count). Without `least` it is what keys and spellings of their lengths
    have at least if they may match (`least_jaccard`). Keys without tokens have
    no pairs.
    """
    of_keys, of_entries = least_jaccard() if least is None else ([least] * (_LENGTHS + 1),) * 2

    def held(rows: DataFrame, key: str, by_length: list[float]) -> DataFrame:
        bound = F.element_at(F.array(*[F.lit(x) for x in by_length]), F.least(F.length(key), F.lit(_LENGTHS)) + 1)
        kept = rows.select("field_name", key).distinct().withColumn("tokens", token_set(F.col(key))).filter("size(tokens) > 0").withColumn("least", bound)
        return materialise(kept, "tokens")

    v, e = held(values, "key", of_keys), held(entries, "entry_key", of_entries)
    rarity = v.select(F.explode("tokens").alias("token")).unionByName(e.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    a = _prefixed(v, rarity, ["field_name", "key"])
    b = _prefixed(e, rarity, ["field_name", "entry_key"])
    b = b.select("field_name", "entry_key", "token", F.col("size").alias("e_size"), F.col("tokens").alias("e_tokens"), F.col("at").alias("e_at"), F.col("least").alias("e_least"))
    # what both have at least for the Jaccard asked for, and at most after the two places
    asked = F.greatest("least", "e_least")
    needed = F.ceil(asked / (1 + asked) * (F.col("size") + F.col("e_size")) - 1e-9)
    left = F.least(F.col("size") - F.col("at"), F.col("e_size") - F.col("e_at"))
    met = (
        a.join(b, ["field_name", "token"])
        .filter((F.col("e_size") >= F.ceil(F.col("size") * asked - 1e-9)) & (F.col("size") >= F.ceil(F.col("e_size") * asked - 1e-9)))
        .filter(F.least("at", "e_at") + left >= needed)
        .dropDuplicates(["field_name", "key", "entry_key"])
    )
    same = F.size(F.array_intersect("tokens", "e_tokens"))
    jaccard = same / (F.col("size") + F.col("e_size") - same)
    return met.withColumn("jaccard", jaccard).filter(F.col("jaccard") >= asked - 1e-9).select("field_name", "key", "entry_key", "jaccard")


def _field_nouns(canonical: DataFrame, names: DataFrame) -> dict[str, list[str]]:
    """What every value of a field is: the first word of the field's name, with the names that it has as an entry itself.

    A list has few fields; an error beyond a thousand.
    """
    fields = [r[0] for r in canonical.filter("field_name is not null").select("field_name").distinct().orderBy("field_name").take(1001)]
    if len(fields) > 1000:
        raise ValueError("a reference list has few fields")
    firsts = {f: re.split(r"[\W_]+", f.lower())[0] for f in fields}
    held: dict[str, set[str]] = {}
    for entry, name in names.filter(F.col("canonical").isin(sorted(set(firsts.values())))).select("canonical", "name").distinct().take(10_000):
        held.setdefault(entry, set()).add(name.lower())
    return {f: sorted({word, word + "s", _TWICE.sub(r"\1", _VOWELS.sub("", word)), *held.get(word, ())}) for f, word in firsts.items()}


def map_values(values: DataFrame, canonical: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """field_name, value, canonical for each distinct value: its entry, or '' if it means none.

    values: field_name, value; canonical: field_name, canonical and, if it has
    one, gloss; names: field_name, canonical, name, the thesaurus (where None
    the default one, an empty table for none). The least sum of costs wins
    (edits, partial reading, derived spelling), then fewest edits, the greatest
    Jaccard, the least name. Null values are left out; empty ones mean none.
    """
    if "gloss" not in canonical.columns:
        canonical = canonical.withColumn("gloss", F.lit(""))
    canonical = canonical.select("field_name", "canonical", "gloss")
    names = (default_names(values.sparkSession) if names is None else names).filter("field_name is not null and canonical is not null and name is not null")
    entries = materialise(spellings(canonical, names), "spellings")
    asked = values.filter("value is not null").select("field_name", "value").distinct()
    longest = entries.agg(F.coalesce(F.max(F.length("entry_key")), F.lit(0))).first()[0] + MOST_EDITS
    keyed = materialise(readings(asked, _field_nouns(canonical, names), longest), "readings")
    pairs = similar_entries(keyed, entries)
    # no more than MOST_EDITS of any kind means no more than twice as many without swaps
    pairs = pairs.filter(F.abs(F.length("key") - F.length("entry_key")) <= MOST_EDITS).filter(F.levenshtein("key", "entry_key", 2 * MOST_EDITS) >= 0)
    close = pairs.withColumn("off", edits(F.col("key"), F.col("entry_key"))).join(entries, ["field_name", "entry_key"])
    scored = keyed.join(close, ["field_name", "key"])
    partial = F.col("cost") >= LAST
    free = F.col("kind").isin("name", "head", "other") & (F.col("off") <= allowed_edits(F.least(F.length("entry_key"), F.length("key") + 1), partial))
    # an abbreviation may lack one more letter between its first and its last
    dropped = (F.col("kind") == "short") & (F.col("off") == 1) & (F.length("key") == F.length("entry_key") - 1) & (F.length("entry_key") > 2)
    dropped &= (F.substring("key", 1, 1) == F.substring("entry_key", 1, 1)) & (F.substring("key", -1, 1) == F.substring("entry_key", -1, 1))
    scored = scored.filter(free | (F.col("off") == 0) | (dropped & ~partial))
    # abbreviations stand for whole parts or the last words, words of the gloss for whole parts
    scored = scored.filter(~((F.col("kind") == "short") & (F.col("cost") >= FIRST)) & ~((F.col("kind") == "gloss") & partial))
    score = EDIT * F.col("off") + F.col("cost") + kind_cost(F.col("kind"))
    chosen = scored.groupBy("field_name", "value").agg(F.min(F.struct(score.alias("score"), "off", (-F.col("jaccard")).alias("j"), "canonical")).alias("b"))
    return asked.join(chosen, ["field_name", "value"], "left").select("field_name", "value", F.coalesce("b.canonical", F.lit("")).alias("canonical"))


def node_values(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """node_id, field_name, value: the fields in nodes' attributes, as text; nulls and damaged attributes give none."""
    held = F.array(*[F.struct(F.lit(f).alias("field_name"), F.get_json_object("attributes", f"$.{f}").alias("value")) for f in fields])
    return nodes.filter("node_id is not null").select("node_id", F.inline(held)).filter("value is not null")


def node_entries(nodes: DataFrame, canonical: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """node_id, field_name, canonical of every node and field whose value isn't literally an entry."""
    known = canonical.select("field_name", F.col("canonical").alias("value")).distinct()
    free = materialise(node_values(nodes, FIELDS).join(known, ["field_name", "value"], "left_anti").distinct(), "free-values")
    return free.join(map_values(free, canonical, names), ["field_name", "value"]).select("node_id", "field_name", "canonical").distinct()
