"""Variant spellings of persons and firms, linked by a pigeonhole segment join.

Every distinct spelling is read once: titles and legal forms are set aside, nicknames and
abbreviated trades are written out, the order of the parts is forgotten. Spellings that read the same
have one *key*. Keys that differ by one typing error (a letter left out, added, replaced, or two
neighbours swapped) differ in one part only. That part is cut into k + 1 = 3 segments (a swap costs
two edits); as two edits can't damage three segments, one of them stands in the other key, shifted by
at most one place. So substrings at shifted places are looked up in an inverted index of (the equal
parts, length, segment number, segment), and what is found is verified by banded edit distance.
The equal parts keep the buckets small even where one surname or trade is very common.

Where one letter more often tells two people apart than a slip of the keys does, in parts of fewer than
``LEAST_PART`` letters and in spellings of one word, and where two parts hold an error each, keys are
linked only if one is ``SLIP`` times as frequent as the other: then the rare one is the error. Such
errors are looked up in the index of frequent keys alone, for two errors by a segment of either part.

Names in another script are compared by their consonants. Linked keys form an entity (minimum label
spreading). A spelling with initials belongs to the entity of that surname and initial; among
several, to the one with the same middle initial, then the most frequent.

Defined results: null, empty and blank names are no spellings; mail addresses and what has digits
belong to nobody; a spelling that reads like no other has no pair; repeated rows count in the
frequency only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.operators.packed import packed_items
from korrel.session import cut

#: Letters of a part from which one typing error is believed whatever the frequencies; letters of each
#: of two parts with an error.
LEAST_PART, LEAST_TWO = 4, 5
#: How many times as frequent the right spelling must be where an error is less sure.
SLIP = 20

# Titles, legal forms, words around a firm's name, trades and nicknames.
TITLES = set("mr mrs ms miss dr prof rev shri shree smt sri sir mme mlle m herr frau hr fr sr sra srta dra don doña श्री श्रीमती सौ डॉ कुमारी".split())
LEGAL = set("ltd limited pvt private llp gmbh inc incorporated corp corporation co company plc ag sa sarl bv kg ohg llc pte (p) p lp".split())
AROUND = set("m/s messrs group the and & of".split())
TRADES = """constructions hospital industries technologies finance logistics traders travels foods school public textiles motors pharma
engineering electronics services solutions consultants exports imports enterprises builders printers publishers insurance bank
college university clinic hotels media systems software chemicals steel power energy farms dairy bakery stores mart""".split()
NICKNAMES = {
    "katherine": "kate kathy kat katie kathi", "margaret": "maggie peggy meg greta marge", "thomas": "tom tommy thom", "priyanka": "priya pri",
    "elizabeth": "liz beth lizzie betty eliza lisa", "zoltan": "zoli", "frederic": "fred freddy fredi", "ignacio": "nacho", "venkatesh": "venky venkat",
    "ramesh": "ramu", "deepika": "deepu dipika", "pooja": "puja", "sunita": "sunu suni", "yasmin": "yas", "gabriele": "gabi gaby", "leonardo": "leo",
    "william": "will bill billy willi", "francisco": "paco pancho", "jorge": "jorgito", "anneliese": "anni anne liesel", "dorothea": "thea doro", "theodora": "dora theo",
    "catarina": "cati cata", "kavita": "kavi", "guillaume": "guigui", "mohammed": "mohd md mohammad muhammad mohamed", "robert": "bob rob robbie bobby",
    "johannes": "hannes johann hans", "bernhard": "berni bernd", "xavier": "xavi", "olivia": "liv livia", "nicolas": "nico nick", "siddharth": "sid siddhu", "abhishek": "abhi",
    "lakshmi": "laxmi lucky", "manoj": "manu", "harpreet": "harry preet", "usha": "ushi", "quirin": "quiri", "alexander": "alex sasha alec xander",
    "michael": "mike mick", "christopher": "chris kit", "richard": "rick dick", "james": "jim jimmy", "charles": "charlie chuck", "edward": "ed eddie ted ned",
    "daniel": "dan danny", "joseph": "joe joey", "samuel": "sam sammy", "benjamin": "ben benny", "anthony": "tony", "andrew": "andy drew", "patricia": "pat patty tricia",
    "jennifer": "jen jenny", "susan": "sue susie", "rebecca": "becky", "victoria": "vicky", "friedrich": "fritz", "sebastian": "basti", "rajesh": "raju", "vijay": "viju",
}
FULL_NAME = {nick: name for name, nicks in NICKNAMES.items() for nick in nicks.split()}

# Consonants of Devanagari letters, as the consonants of Latin spellings are written below.
DEVANAGARI = dict(zip("कखगघचछजझटठडढणतथदधनपफबभमयरलळवशषसहङञ", "kkggccjjttttntttdnpfbbmyrllvsss\0nn".replace("\0", "h")))
DEVANAGARI |= dict(zip("टठडढणतथदधन", "ttddnttddn"))

_SPLIT = regex.compile(r"[\s,]+")


def consonants(part: str) -> str:
    """The consonants of a part as they are heard, the same for Latin and Devanagari spellings."""
    text = unicodedata.normalize("NFD", part.lower())
    if regex.search(r"\p{Devanagari}", text):
        out = "".join("n" if c in "ंँ" else DEVANAGARI.get(c, "") for c in text.replace("फ़", "फ").replace("ज़", "ज").replace("क्ष", "कस"))
    else:
        text = regex.sub(r"\p{M}", "", text)
        for a, b in (("ph", "f"), ("sch", "s"), ("ch", "\1"), ("ck", "k"), ("x", "ks"), ("q", "k"), ("c", "k"), ("\1", "c"), ("z", "j"), ("w", "v")):
            text = text.replace(a, b)
        text = regex.sub(r"(?<=[bcdfgjklmnprstv])h", "", text)
        out = regex.sub(r"[^bcdfghjklmnprstvy]", "", text)
    return regex.sub(r"(.)\1+", r"\1", regex.sub(r"(?<=.)[hy]", "", out))


def one_error(a: str, b: str) -> bool:
    """Whether two words are equal or one typing error apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


_trades: dict[str, str | None] = {}


def trade_of(word: str) -> str | None:
    """The trade that a word says, written out, shortened or with a typing error; None if none.
    What was found is kept for up to 200,000 words."""
    if word not in _trades:
        if len(_trades) >= 200_000:
            _trades.clear()
        _trades[word] = _trade_of(word)
    return _trades[word]


def _trade_of(word: str) -> str | None:
    bare = word.rstrip(".")
    if bare in TRADES:
        return bare
    if len(bare) >= 3:
        for t in TRADES:
            if t.startswith(bare) and (word.endswith(".") or bare in ("tech", "hosp", "constr", "logist", "inds", "pharma")):
                return t
        for t in TRADES:
            if regex.sub(r"[aeiou]", "", t) == bare:
                return t
        if word.endswith(".") and len(bare) >= 3:
            for t in TRADES:  # inds. for industries: letters in order, first and last of its stem
                if t[0] == bare[0] and regex.match(".*".join(map(regex.escape, bare)), t):
                    return t
        for t in TRADES:
            if len(bare) >= 6 and one_error(bare, t):
                return t
    return None


def read(name: str) -> dict | None:
    """What a spelling says: kind, key, parts, and for persons initial, surname and middle initial."""
    text = unicodedata.normalize("NFC", name).strip()
    if not text or "@" in text or regex.search(r"\d", text):
        return None
    words = [w for w in _SPLIT.split(text) if w]
    bare = [w.replace(".", "") for w in words]
    firm = [b in LEGAL and len(b) > 1 or w in ("m/s", "(p)") or b == "group" for w, b in zip(words, bare)]
    trades = [trade_of(w) for w in words]
    if any(firm) or (any(trades) and len(words) > 1):
        said = sorted({t for t in trades if t})
        stem = [b for b, w, t in zip(bare, words, trades) if not t and b not in LEGAL and w not in AROUND and b]
        if stem:
            return {"kind": "firm", "parts": [" ".join(stem), " ".join(said)], "initial": "", "surname": "", "middle": ""}
    comma = "," in text
    while words and words[0].rstrip(".") in TITLES and len(words) > 1 and (len(words[0].rstrip(".")) > 1 or len(words) > 3):
        words = words[1:]
    parts = [w.rstrip(".") for w in words if w.rstrip(".")]
    single = [p for p in parts if len(p) == 1]
    full = [FULL_NAME.get(p, p) for p in parts if len(p) > 1]
    if not full:
        return None
    if len(full) == 1:
        if not single:
            return {"kind": "word", "parts": full, "initial": "", "surname": "", "middle": ""}
        return {"kind": "initial", "parts": [single[0], full[0]], "initial": single[0], "surname": full[0], "middle": single[1] if len(single) > 1 else ""}
    return {"kind": "person", "parts": sorted(full), "initial": "", "surname": "", "middle": single[0] if single and not comma else ""}


def spellings(files: DataFrame, field: str = "owner_names") -> DataFrame:
    """(name, n): every distinct spelling of the field, in small letters, with its frequency."""
    items = packed_items(files, [field]).select(F.explode("items").alias("item"))
    return items.select(F.trim(F.regexp_replace(F.lower("item"), r"\s+", " ")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for name, n in zip(b["name"], b["n"]):
            r = read(name)
            if r:
                latin = not regex.search(r"\p{Devanagari}", name)
                heard = " ".join(sorted(map(consonants, r["parts"]))) if r["kind"] == "person" else ""
                out.append((name, n, r["kind"], f"{r['kind']}:{'|'.join(r['parts'])}", r["parts"], r["initial"], r["surname"], r["middle"], latin, heard))
        yield pd.DataFrame(out, columns=["name", "n", "kind", "key", "parts", "initial", "surname", "middle", "latin", "heard"])


def _segment(part: str, length: str, i: int, of: int, shift: int = 0) -> str:
    """SQL of segment ``i`` of ``of`` of a word of ``length`` letters, read from ``part`` at a shifted place."""
    start, end = f"cast(floor({length} * {i} / {of}) as int)", f"cast(floor({length} * {i + 1} / {of}) as int)"
    return f"substring({part}, {start} + 1 + {shift}, {end} - {start})"


def _near_keys(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: keys of (key, kind, parts, n) of one kind whose parts are one typing error apart, or
    two where the frequencies say so."""
    # one row per part that may be wrong: the others must be equal
    open_part = keys.select("key", "kind", "parts", "n", F.posexplode("parts").alias("at", "part")).where((F.length("part") >= 2) & ((F.col("kind") != "firm") | (F.col("at") == 0)))
    rest = F.array_join(F.filter("parts", lambda x, i: i != F.col("at")), "|")
    unsure = (F.length("part") < LEAST_PART) | (F.col("kind") == "word")
    held = open_part.select("key", "part", "n", unsure.alias("unsure"), F.concat_ws(":", "kind", F.size("parts"), rest).alias("rest"), F.length("part").alias("len"))
    index = held.where(~F.col("unsure") | (F.col("n") >= SLIP)).select("key", "part", "n", "rest", "len", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.expr(_segment("part", "len", i, 3)).alias("seg")) for i in range(3)])).alias("s"))
    index = index.select("key", "part", "n", "rest", "len", "s.i", "s.seg")
    # a pair is found from its longer word; of unsure words, which are not all in the index, from either
    looks = [
        (F.struct((F.col("len") - d).alias("len"), F.lit(i).alias("i"), F.expr(_segment("part", f"(len - {d})", i, 3, shift)).alias("seg")), d)
        for d, shifts in ((0, (0,)), (1, (0, 1)), (-1, (0, -1)))
        for i in range(3)
        for shift in shifts
    ]
    sought = F.array(*[look for look, d in looks if d >= 0])
    probe = held.select(F.col("key").alias("other"), F.col("part").alias("other_part"), F.col("n").alias("other_n"), "unsure", "rest", F.explode(F.when(F.col("unsure"), F.array(*[look for look, _ in looks])).otherwise(sought)).alias("s")).select("other", "other_part", "other_n", "unsure", "rest", "s.len", "s.i", "s.seg")
    found = probe.join(index, ["rest", "len", "i", "seg"]).where("key <> other")
    found = found.where(~F.col("unsure") & (F.length("part") >= LEAST_PART) | (F.greatest("n", "other_n") >= SLIP * F.least("n", "other_n")))
    found = found.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"), "part", "other_part").distinct()
    edits = F.levenshtein("part", "other_part", 2)
    swapped = (edits == 2) & (F.length("part") == F.length("other_part")) & (F.array_sort(F.split("part", "")) == F.array_sort(F.split("other_part", "")))
    return found.where((edits == 1) | swapped).select("a", "b").unionByName(_two_errors(keys)).distinct()


def _two_errors(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: keys of two parts with one edit in each, one key far more frequent than the other."""
    two = keys.where((F.size("parts") == 2) & (F.col("kind") == "person") & (F.length(F.get("parts", 0)) >= LEAST_TWO) & (F.length(F.get("parts", 1)) >= LEAST_TWO))
    two = two.select("key", "n", F.get("parts", 0).alias("p"), F.get("parts", 1).alias("q")).withColumns({"lp": F.length("p"), "lq": F.length("q")})

    def cells(part: str, length: str, looked_up: bool) -> F.Column:
        ways = [(d, i, shift) for d in ((-1, 0, 1) if looked_up else (0,)) for i in (0, 1) for shift in ((0, d) if d and looked_up else (0,))]
        return F.array(*[F.struct((F.col(length) - d).alias("l"), F.lit(i).alias("i"), F.expr(_segment(part, f"({length} - {d})", i, 2, shift)).alias("seg")) for d, i, shift in ways])

    def spread(rows: DataFrame, looked_up: bool) -> DataFrame:
        left = rows.withColumn("x", F.explode(cells("p", "lp", looked_up)))
        return left.withColumn("y", F.explode(cells("q", "lq", looked_up))).select("key", "n", "p", "q", "x", "y")

    index = spread(two.where(F.col("n") >= SLIP), False)
    probe = spread(two, True).select(F.col("key").alias("other"), F.col("n").alias("other_n"), F.col("p").alias("other_p"), F.col("q").alias("other_q"), "x", "y")
    found = probe.join(index, ["x", "y"]).where((F.col("n") >= SLIP * F.col("other_n")) & (F.levenshtein("p", "other_p", 1) == 1) & (F.levenshtein("q", "other_q", 1) == 1))
    return found.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))


def _entities(keys: DataFrame, links: DataFrame) -> DataFrame:
    """(key, entity): the smallest key that each key is linked with, over any number of links."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(keys.select("key", F.col("key").alias("entity")))
    while True:
        near = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("entity").alias("near"))
        stepped = labels.join(near.withColumnRenamed("a", "key"), "key", "left").select("key", F.least("entity", "near").alias("entity"), (F.col("near") < F.col("entity")).alias("moved"))
        stepped = cut(stepped)
        if stepped.where("moved").isEmpty():
            return stepped.select("key", "entity")
        # on to the entity of the entity, so that long chains take few rounds
        further = stepped.select(F.col("key").alias("entity"), F.col("entity").alias("further"))
        labels = cut(stepped.select("key", "entity").join(further, "entity").select("key", F.least("entity", "further").alias("entity")))


def linked_spellings(files: DataFrame, field: str = "owner_names") -> DataFrame:
    """(name, n, entity): every spelling with the entity it belongs to."""
    named = cut(spellings(files, field).mapInPandas(_read_batches, "name string, n bigint, kind string, key string, parts array<string>, initial string, surname string, middle string, latin boolean, heard string"))
    keys = named.groupBy("key", "kind").agg(F.first("parts").alias("parts"), F.sum("n").alias("n"))
    typed = _near_keys(keys)
    persons = named.where("kind = 'person' AND heard <> ''").select("key", "heard", "latin").distinct()
    foreign = persons.where("NOT latin").select(F.col("key").alias("a"), "heard").distinct()
    heard = foreign.join(persons.where("latin").select(F.col("key").alias("b"), "heard").distinct(), "heard").select("a", "b")
    entity = _entities(keys, typed.unionByName(heard))
    placed = cut(named.join(entity, "key"))
    # initials: the entity of that surname and initial with the same middle initial, then the most frequent
    whole = placed.where("kind = 'person'")
    weight = whole.groupBy("entity").agg(F.sum("n").alias("weight"), F.collect_set(F.when(F.col("middle") != "", F.col("middle"))).alias("middles"))
    ways = whole.where("size(parts) = 2").select("entity", F.explode(F.array(F.struct(F.expr("substring(parts[0], 1, 1)").alias("initial"), F.expr("parts[1]").alias("surname")), F.struct(F.expr("substring(parts[1], 1, 1)").alias("initial"), F.expr("parts[0]").alias("surname")))).alias("w")).select("entity", "w.*").distinct()
    short = placed.where("kind = 'initial'")
    asked = short.groupBy("entity", "initial", "surname").agg(F.max("middle").alias("middle"))
    fits = asked.select(F.col("entity").alias("short"), "initial", "surname", "middle").join(ways, ["initial", "surname"]).join(weight, "entity")
    best = fits.groupBy("short").agg(F.max_by("entity", F.struct(F.array_contains("middles", F.col("middle")), "weight", "entity")).alias("whole"))
    return placed.join(best.withColumnRenamed("short", "entity"), "entity", "left").select("name", "n", F.coalesce("whole", "entity").alias("entity"))


def variant_pairs(files: DataFrame, field: str = "owner_names") -> DataFrame:
    """(name_a, name_b), name_a < name_b: pairs of different spellings of one person or firm."""
    linked = linked_spellings(files, field).select("name", "entity")
    other = linked.select(F.col("name").alias("name_b"), "entity")
    return linked.withColumnRenamed("name", "name_a").join(other, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
