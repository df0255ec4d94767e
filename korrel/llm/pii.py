"""Personal data in free text: a skip-chain conditional random field over the tokens of each file.

The texts of a file (snippet, owners, entities) are one document. Tokens are mail addresses, runs of
numbers, words and marks; each gets one of the labels below. Potentials come from features of a token
and its neighbours, from pairs of neighbouring labels, and from *skip* pairs: repeated or similar
name-like or number-like tokens anywhere in the document share a potential that rewards equal entity
types. Similar are numbers of equal digits, names and their nicknames, and words one typing error apart.
Inference is loopy: exact message passing along every chain, then messages over the skip pairs, and
again, ``ROUNDS`` times.

The weights are trained here, by gradient steps on the likelihood of the chains and then of the skip
pairs under the beliefs of the chains, on the ``TRAIN_FILES`` files of the
smallest hashes. Their labels come from rules that are sure rather than complete: words that announce
numbers, the layout of addresses, and the first and last names that owners bear in all files.

Defined results: null, empty and blank fields have no items; a title, or the word before a number,
is no part of an item in a text; an item of ``owner_names`` or ``entities`` is a whole value of the
field; the same item at two places of one text is one row; texts of any length are read as a whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.names import AROUND, FULL_NAME, LEGAL, TITLES, one_error, read, trade_of
from korrel.operators.packed import packed_items, places
from korrel.session import cut, lookup

LABELS = ["O", "EMAIL", "PHONE", "ID_NUMBER", "NAME_B", "NAME_I", "ADDRESS_B", "ADDRESS_I"]
INDEX = {x: i for i, x in enumerate(LABELS)}
TYPE_OF = np.array([0, 1, 2, 3, 4, 4, 5, 5])  # labels of one entity type
TYPES = ["", "EMAIL", "PHONE", "ID_NUMBER", "NAME", "ADDRESS"]

#: Files that the weights are trained on, at most; gradient steps; rounds of skip messages.
TRAIN_FILES, STEPS, ROUNDS = 2400, 30, 2
#: Names of one mention in NAME_SHARE or more, at most NAME_SHARE, are broadcast; each file gets the
#: rarer ones among its own words by a join.
NAME_SHARE = 50_000
#: Bits of the filter that keeps most other words out of that join. Only speed depends on them.
FILTER_BITS = 1 << 23
#: Documents inferred at once.
BATCH = 512
#: Width of the prior of the skip weight, the reward, in log units, of equal types at the ends of a skip pair.
SKIP_PRIOR = 0.1

# Words that announce a phone number or a number of a person, and parts of addresses.
PHONE_WORDS = set(
    """call ring phone tel telephone cell mobile fon fone telefon anrufen bitte appeler llamar ligar telefono teléfono móvil portable fax whatsapp
    फ़ोन फोन मोबाइल 电话 電話 手机 携帯 โทร தொலைபேசி ফোন রিং""".split()
)
ID_WORDS = set(
    """aadhaar aadhar pan ssn passport passeport pasaporte reisepass dni nie nif nir nino steuer-id ausweis-nr personalausweis cpf nric
    आधार पैन ஆதார் பான் আধার প্যান บัตรประชาชน 护照 身份证 社保 マイナンバー パスポート""".split()
)
ID_PHRASES = [("ni", "number"), ("ausweis", "nr"), ("steuer", "id"), ("sécurité", "sociale"), ("social", "security"), ("national", "insurance"), ("identity", "card"), ("tax", "id"), ("id", "no")]
OTHER_WORDS = set("order invoice ticket tracking ref build lot size total isbn code binder issue room version page serial batch bytes sku model".split())
STREET_WORDS = set(
    """street st road rd lane close avenue ave drive dr boulevard court square terrace way crescent place hill walk marg gali path nagar cross
    calle c avda avenida plaza paseo rue impasse quai allée chemin place weg straße strasse gasse allee platz ufer मार्ग गली पथ रोड""".split()
)
HOUSE_WORDS = set("house flat plot h.no hno no apt apartment unit मकान फ्लैट प्लॉट घर".split())

MAIL = r"(?<![\w.+\-])[A-Za-z0-9][A-Za-z0-9._+\-]*+ ?(?:@|\(at\)) ?[A-Za-z0-9\-]++(?:(?:\.| ?\(dot\) ?)[A-Za-z0-9\-]++)+"
NUMBER = r"(?<![\p{L}\p{M}\p{Nd}])(?:\(?\+?\p{Nd}+\)?|[A-Z]{1,5}-?\p{Nd}[A-Z\p{Nd}]*+|QQ(?= \p{Nd}))(?:(?:[ .\-/]|(?<=\)) ?)?(?:\(?\p{Nd}+\)?|(?<=\p{Nd})[A-Z]{1,3}(?=\p{Nd})\p{Nd}+))*(?:[ \-]?[A-Z])?(?![\p{L}\p{M}\p{Nd}])"
TIGHT_NUMBER = NUMBER.replace("[ .\\-/]", "[.\\-/]").replace("(?<=\\)) ?", "(?<=\\))").replace("(?:[ \\-]?[A-Z])?", "(?:-?[A-Z])?")


def _token(mail: str, number: str, initial: str, flags: int = 0) -> regex.Pattern:
    return regex.compile(rf"({mail})|({number})|({initial}\.(?=[\s ]*\p{{L}}))|([\p{{L}}\p{{M}}\p{{Nd}}’']++(?:-\p{{L}}[\p{{L}}\p{{M}}]++)*)|(\S)", flags)


#: By (values of packed fields, mail addresses possible): texts without any are read faster.
TOKENS = {
    (False, True): _token(MAIL, NUMBER, r"\p{Lu}"), (False, False): _token("(?!)", NUMBER, r"\p{Lu}"),
    (True, True): _token(MAIL, TIGHT_NUMBER, r"\p{L}", regex.IGNORECASE), (True, False): _token("(?!)", TIGHT_NUMBER, r"\p{L}", regex.IGNORECASE),
}


@dataclass(slots=True)
class Token:
    """A token of a document, with its place in its own text."""

    start: int
    end: int
    text: str
    kind: str  # mail, number, initial, word, mark
    low: str


@dataclass
class Names:
    """First and last names that owners bear: the frequent ones of all files, or the rare ones of one."""

    first: set[str] = field(default_factory=set)
    last: set[str] = field(default_factory=set)


def tokens_of(text: str, any_case: bool = False) -> list[Token]:
    """The tokens of a text, in order."""
    kinds = ("mail", "number", "initial", "word", "mark")
    return [Token(m.start(), m.end(), m.group(), kinds[m.lastindex - 1], m.group().lower()) for m in TOKENS[any_case, "@" in text or "(at)" in text.lower()].finditer(text)]


def shape_of(t: Token) -> str:
    """The form of a token."""
    if t.kind == "number":
        digits = sum(c.isdigit() for c in t.text)
        letters = sum(c.isalpha() for c in t.text)
        first = "+" if t.text[0] in "+(" else "0" if t.text.startswith("0") else "a" if t.text[0].isalpha() else "d"
        groups = 1 + sum(not c.isalnum() for c in t.text.strip("()+"))
        return f"n{min(digits, 14)}{first}{min(letters, 3)}g{min(groups, 4)}"
    if t.kind != "word":
        return t.kind
    if t.text.isupper() and len(t.text) > 1:
        return "XX"
    return "Xx" if t.text[0].isupper() else "xx" if t.text[0].islower() else "other"


def flag_of(t: Token, names: Names, known: dict[str, str], rare: dict[str, str]) -> str:
    """What lists say of a token. ``known`` keeps what was said of words, ``rare`` has the file's rare names."""
    if t.kind != "word":
        return t.kind
    w = t.low
    if rare and w in rare:
        return rare[w]
    if (flag := known.get(w)) is None:
        flag = _word_flag(w, names)
        if len(known) < 200_000:
            known[w] = flag
    return flag


def _word_flag(w: str, names: Names) -> str:
    if len(w) == 1 and w.isalpha() and w.isascii():
        return "letter"
    if w in names.last:
        return "last"
    if w in names.first or w in FULL_NAME:
        return "first"
    if w in TITLES:
        return "title"
    if w in PHONE_WORDS:
        return "phone"
    if w in ID_WORDS:
        return "id"
    if w in OTHER_WORDS or w.partition("-")[0] in OTHER_WORDS:
        return "other"
    if w in HOUSE_WORDS:
        return "house"
    if w in STREET_WORDS or w.endswith(("weg", "gasse", "allee", "straße", "strasse")) and len(w) > 5:
        return "street"
    if w in LEGAL or w in AROUND or (len(w) > 3 and trade_of(w)):
        return "firm"
    return "-"


def weak_labels(tokens: list[Token], flags: list[str], free: bool) -> list[int]:
    """Labels by rules. ``free`` texts are sentences, others the values of a packed field."""
    n = len(tokens)
    out = [0] * n
    low = [t.low for t in tokens]

    def words_before(i: int, most: int) -> list[str]:
        got, j = [], i - 1
        while j >= 0 and len(got) < most and i - j < 7:
            if tokens[j].kind == "word" or tokens[j].kind == "initial":
                got.append(low[j].rstrip("."))
            elif tokens[j].text not in ":.-°()":
                break
            j -= 1
        return got

    for i, t in enumerate(tokens):
        if out[i]:
            continue  # within an address
        if t.kind == "mail":
            out[i] = INDEX["EMAIL"]
        elif t.kind == "number":
            digits = sum(c.isdigit() for c in t.text)
            letters = sum(c.isalpha() for c in t.text)
            before = words_before(i, 3)
            after = next((low[j] for j in range(i + 1, min(i + 3, n)) if tokens[j].kind == "word"), "")
            said_id = free and (any(b in ID_WORDS for b in before[:2]) or any(tuple(before[k : k + 2][::-1]) in ID_PHRASES for k in range(2)))
            if said_id and digits >= 4:
                out[i] = INDEX["ID_NUMBER"]
            elif free and (any(b.partition("-")[0] in OTHER_WORDS for b in before[:2]) or after in OTHER_WORDS):
                out[i] = 0
            elif letters == 0 and 9 <= digits <= 14 and (any(b in PHONE_WORDS for b in before[:2]) or after in PHONE_WORDS or t.text[0] in "+" or t.text.startswith("(+") or not free):
                out[i] = INDEX["PHONE"]
            elif letters == 0 and 9 <= digits <= 14 and i and tokens[i - 1].text == "," and out[i - 2] == INDEX["ADDRESS_I"]:
                out[i] = INDEX["PHONE"]
            elif not free and letters and digits >= 4:
                out[i] = INDEX["ID_NUMBER"]
        if out[i] or t.kind == "mark":
            continue
        end = address_end(tokens, flags, i, free)
        if end:
            out[i] = INDEX["ADDRESS_B"]
            out[i + 1 : end] = [INDEX["ADDRESS_I"]] * (end - i - 1)
    named = ("first", "last", "initial") if free else ("first", "last", "initial", "letter")
    # a value of nothing but names is one, even where a rare surname was only seen before a first name
    whole = not free and all(f in named or f in ("title", "mark") for f in flags)

    def goes_on(j: int) -> bool:
        """Whether token ``j`` belongs to the name before it: a name, the dot of a shortened one, or in a
        value the comma after a surname."""
        if flags[j] in named:
            return True
        after = j + 1 < n and flags[j + 1] in named
        return after and (low[j] == "." and flags[j - 1] == "first" and len(low[j - 1]) <= 5 or whole and low[j] == "," and flags[j - 1] in ("first", "last"))

    i = 0
    while i < n:
        if out[i] or flags[i] not in named:
            i += 1
            continue
        j = i
        while j < n and not out[j] and goes_on(j):
            j += 1
            if not free and flags[j - 1] == "last" and j - i >= 2 and flags[i] == "first":
                break  # names follow each other
        run = [f for f in flags[i:j] if f != "mark"]
        sure = len(run) >= 2 and ("last" in run or whole and "first" in run)
        if sure and not (j < n and flags[j] == "firm" and not (free and low[j] in AROUND)):
            out[i] = INDEX["NAME_B"]
            out[i + 1 : j] = [INDEX["NAME_I"]] * (j - i - 1)
        i = max(j, i + 1)
    return out


def address_end(tokens: list[Token], flags: list[str], i: int, free: bool) -> int:
    """Where an address that starts at token ``i`` ends (exclusive), 0 if none starts there."""
    t = tokens[i]
    has_house, has_street, commas, j = False, False, 0, i
    later = tokens[i + 1].low if i + 1 < len(tokens) else ""
    numbered = t.kind == "number" or t.kind == "word" and regex.fullmatch(r"\d+[a-z]?", t.low) is not None
    if not (flags[i] in ("house", "street") or numbered or (t.low == "am" and later) or (t.low == "c" and later == "/") or (t.low == "h." and later == "no")):
        return 0
    if t.kind == "number" and sum(c.isdigit() for c in t.text) > 4:
        return 0
    while j < len(tokens) and j - i < 22:
        u = tokens[j]
        digits = sum(c.isdigit() for c in u.text) if u.kind == "number" else 0
        if u.kind == "mail" or digits > 6 or u.text in ";|":
            break
        if u.kind == "number":
            if 5 <= digits <= 6:
                if not (has_house and has_street and commas):
                    return 0
                # the postal code ends the address, or the town after it does
                k = j + 1
                if tokens[j - 1].text == "," and k < len(tokens) and tokens[k].kind == "word":
                    k += 1
                    while k + 1 < len(tokens) and tokens[k].text == "-" and tokens[k + 1].kind == "word":
                        k += 2
                return k
            has_house = True
        elif flags[j] == "street" or u.low in ("c", "avda") or (j == i and u.low == "am"):
            has_street = True
        elif u.text == ",":
            commas += 1
        elif u.kind == "word" and regex.fullmatch(r"\d+[a-z]{0,2}", u.low):
            has_house = True
        elif u.kind == "mark" and u.text not in ".-/º°":
            break
        elif u.kind == "word" and free and u.text[0].islower() and flags[j] not in ("house", "street") and u.low not in ("bis", "ter", "de", "du", "des", "la", "le", "los", "las", "del", "am", "der", "el", "l'", "a", "b", "º", "ª"):
            break
        if j > i and u.text == "." and j + 1 < len(tokens) and tokens[j + 1].kind == "word" and flags[j - 1] not in ("street", "house") and tokens[j - 1].low not in ("no", "h", "avda", "ave", "rd") and tokens[j + 1].low not in ("º", "ª"):
            break
        j += 1
    return 0


def feature_rows(tokens: list[Token], flags: list[str], where: str) -> list[list[str]]:
    """The features of every token of one text."""
    n = len(tokens)
    shapes = [shape_of(t) for t in tokens]
    form = [s if t.kind in ("number", "mail") else t.low for t, s in zip(tokens, shapes)]
    words = [i for i, t in enumerate(tokens) if t.kind in ("word", "initial")]
    out = []
    before: list[str] = ["^", "^"]
    said: list[str] = ["^", "^"]
    following = iter(words)
    coming = next(following, None)
    for i, t in enumerate(tokens):
        while coming is not None and coming <= i:
            coming = next(following, None)
        p1, p2 = form[i - 1] if i else "^", form[i - 2] if i > 1 else "^"
        n1, n2 = form[i + 1] if i + 1 < n else "$", form[i + 2] if i + 2 < n else "$"
        f0, fp, fn = flags[i], flags[i - 1] if i else "^", flags[i + 1] if i + 1 < n else "$"
        s0 = shapes[i]
        # the words before, if near: what announces a number
        pw = before[-1] if words else "^"
        out.append([
            f"w={form[i]}", f"s={s0},{where}", f"f={f0},{s0}", f"p={p1}", f"n={n1}", f"pp={p2},{p1}", f"nn={n1},{n2}", f"fp={fp},{f0}", f"fn={f0},{fn}",
            f"fff={fp},{f0},{fn}", f"pw={pw},{t.kind}", f"pw2={before[-2]},{before[-1]},{t.kind}", f"nw={form[coming] if coming is not None else '$'},{t.kind}", f"sp={shapes[i - 1] if i else '^'},{s0}", f"pf={said[-2]},{said[-1]},{s0 if t.kind != 'word' else f0}", f"nf={flags[coming] if coming is not None else '$'},{t.kind}", f"sn={s0},{shapes[i + 1] if i + 1 < n else '$'}",
        ])
        if t.kind in ("word", "initial"):
            before.append(t.low)
            said.append(f0)
        elif t.kind in ("number", "mail") or t.text in ",;":
            before += ["^", "^"] if t.kind == "mark" else [form[i]]
            said += ["^", "^"] if t.kind == "mark" else [t.kind]
    return out


FEATURES = 17


@dataclass
class Model:
    """Weights of features, of neighbouring labels, of first labels; and the names."""

    index: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray
    names: Names
    skip: float = 0.0


def spellings_near(word: str) -> set[str]:
    """Marks of a word that it shares with all words one typing error apart: the word itself, and
    without any one letter."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class Document:
    """The texts of one file with their tokens."""

    __slots__ = ("parts", "tokens", "flags", "begins", "rows")

    def __init__(self, parts: list[tuple[str, str, bool]], names: Names, known: dict[str, str], rare: dict[str, str]) -> None:
        self.parts = parts  # (field, text, free)
        self.tokens: list[Token] = []
        self.flags: list[str] = []
        self.begins: list[int] = []
        self.rows: list[list[str]] = []
        for where, text, free in parts:
            self.begins.append(len(self.tokens))
            own = tokens_of(text, not free)
            flags = [flag_of(t, names, known, rare) for t in own]
            self.rows += feature_rows(own, flags, where)
            self.tokens += own
            self.flags += flags
        self.begins.append(len(self.tokens))

    def weak(self) -> list[int]:
        """Labels by rules."""
        out: list[int] = []
        for k, (_, _, free) in enumerate(self.parts):
            a, b = self.begins[k], self.begins[k + 1]
            out += weak_labels(self.tokens[a:b], self.flags[a:b], free)
        return out

    def skips(self) -> list[tuple[int, int]]:
        """Pairs of places with repeated or similar tokens that may be entities: each with the last
        such before it."""
        last: dict[str, int] = {}
        near: dict[str, int] = {}
        out = []
        for i, t in enumerate(self.tokens):
            if t.kind == "number" and len(t.text) >= 5:
                same = "".join(c for c in t.text if c.isalnum()).lstrip("0").lower()
            elif t.kind == "word" and len(t.low) >= 3 and (t.text[0].isupper() or self.flags[i] in ("first", "last")):
                same = FULL_NAME.get(t.low, t.low)
            else:
                continue
            if same in last:
                out.append((last[same], i))
            elif t.kind == "word" and len(same) >= 5:
                marks = spellings_near(same)
                alike = [near[m] for m in marks if m in near]
                alike = [k for k in alike if one_error(same, FULL_NAME.get(self.tokens[k].low, self.tokens[k].low))]
                if alike:
                    out.append((max(alike), i))
                near.update(dict.fromkeys(marks, i))
            last[same] = i
        return out


def _padded(docs: list[Document], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, is a token, begins a text) of documents side by side."""
    longest = max((len(d.tokens) for d in docs), default=0)
    x = np.zeros((len(docs), longest, FEATURES), dtype=np.int32)
    there = np.zeros((len(docs), longest), dtype=bool)
    begins = np.zeros((len(docs), longest), dtype=bool)
    for k, d in enumerate(docs):
        n = len(d.tokens)
        if n:
            x[k, :n] = [[index.get(f, 0) for f in row] for row in d.rows]
        there[k, :n] = True
        begins[k, [b for b in d.begins if b < n]] = True
    return x, there, begins


def beliefs(unary: np.ndarray, there: np.ndarray, begins: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, forward, backward with unary) along the chains; a chain begins where a text does.
    All are scaled to sums of 1, token by token."""
    b, n, k = unary.shape
    own = np.exp(unary - unary.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()  # token by token
    go, start = np.exp(steps), np.exp(first)
    fwd, bwd = np.empty((n, b, k)), np.ones((n, b, k))
    for i in range(n):
        come = start if i == 0 else np.where(begins[:, i, None], start, fwd[i - 1] @ go)
        fwd[i] = come * own[i]
        fwd[i] /= fwd[i].sum(axis=1, keepdims=True)
    goes = there[:, 1:] & ~begins[:, 1:]
    for i in range(n - 2, -1, -1):
        back = (own[i + 1] * bwd[i + 1]) @ go.T
        back /= back.sum(axis=1, keepdims=True)
        bwd[i] = np.where(goes[:, i, None], back, 1.0)
    both = fwd * bwd
    both /= both.sum(axis=2, keepdims=True)
    return both.transpose(1, 0, 2), fwd.transpose(1, 0, 2), (own * bwd).transpose(1, 0, 2)


def train(docs: list[Document], labels: list[list[int]], names: Names, steps: int = STEPS) -> Model:
    """Weights by adaptive gradient steps on the likelihood of the chains."""
    counts = Counter(f for d in docs for row in d.rows for f in row)
    index = {f: i + 1 for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 3))}
    k = len(LABELS)
    w, trans, first = np.zeros((len(index) + 1, k)), np.zeros((k, k)), np.zeros(k)
    seen = [np.full_like(a, 1e-6) for a in (w, trans, first)]
    order = sorted(range(len(docs)), key=lambda i: len(docs[i].tokens))
    groups = []
    for a in range(0, len(order), 128):
        own = [docs[i] for i in order[a : a + 128]]
        x, there, begins = _padded(own, index)
        y = np.zeros(there.shape, dtype=np.int64)
        for r, i in enumerate(order[a : a + 128]):
            y[r, : len(labels[i])] = labels[i]
        if there.shape[1]:
            groups.append((x, there, begins, y))
    for _ in range(steps):
        for x, there, begins, y in groups:
            unary = w[x].sum(axis=2)
            marginal, fwd, after = beliefs(unary, there, begins, trans, first)
            gap = marginal.copy()
            np.put_along_axis(gap, y[:, :, None], np.take_along_axis(gap, y[:, :, None], 2) - 1, 2)
            gap[~there] = 0
            gw = np.zeros_like(w)
            flat, each = x[there], gap[there]
            for c in range(k):
                gw[:, c] = np.bincount(flat.ravel(), weights=np.repeat(each[:, c], FEATURES), minlength=len(w))
            inner = there[:, 1:] & ~begins[:, 1:]
            left, right, go = fwd[:, :-1][inner], after[:, 1:][inner], np.exp(trans)
            whole = ((left @ go) * right).sum(axis=1, keepdims=True)
            gt = (left.T @ (right / whole)) * go
            np.add.at(gt, (y[:, :-1][inner], y[:, 1:][inner]), -1)
            gf = gap[begins].sum(axis=0)
            for a, g, s in ((w, gw + 0.003 * w, seen[0]), (trans, gt + 0.01 * trans, seen[1]), (first, gf, seen[2])):
                g[0] = g[0] if a is not w else 0
                s += g * g
                a -= 0.3 * g / np.sqrt(s)
    model = Model(index, w.astype(np.float32), trans, first, names)
    model.skip = _skip_weight(docs, labels, model)
    return model


def _skip_weight(docs: list[Document], labels: list[list[int]], model: Model) -> float:
    """The reward of equal types at which the skip pairs' labels are the likeliest, with what the chains
    believe of both ends, under a prior that keeps it small."""
    equal, believed = [], []
    order = sorted(range(len(docs)), key=lambda i: len(docs[i].tokens))
    for a in range(0, len(order), 128):
        rows = order[a : a + 128]
        pairs = [(r, i, j) for r, k in enumerate(rows) for i, j in docs[k].skips()]
        if not pairs:
            continue
        x, there, begins = _padded([docs[k] for k in rows], model.index)
        marginal = beliefs(model.weights[x].sum(axis=2).astype(np.float64), there, begins, model.steps, model.first)[0]
        r, i, j = np.array(pairs).T
        same = (TYPE_OF[:, None] == TYPE_OF[None, :]).astype(float)
        believed.append(((marginal[r, i] @ same) * marginal[r, j]).sum(axis=1))
        equal.append([TYPE_OF[labels[rows[q]][b]] == TYPE_OF[labels[rows[q]][c]] for q, b, c in pairs])
    if not equal:
        return 0.0
    p, y = np.clip(np.concatenate(believed), 1e-6, 1 - 1e-6), np.concatenate(equal)
    low, high = 0.0, 4.0
    for _ in range(40):  # the slope of the likelihood falls with the weight
        at = (low + high) / 2
        odds = p * np.exp(at) / (1 - p)
        slope = (y - odds / (1 + odds)).sum() - at / SKIP_PRIOR**2
        low, high = (at, high) if slope > 0 else (low, at)
    return low


def infer(docs: list[Document], model: Model) -> list[np.ndarray]:
    """The labels of every token of the documents, by loopy message passing."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(docs)
    order = sorted(range(len(docs)), key=lambda i: len(docs[i].tokens))
    at = 0
    while at < len(order):
        # longer documents in smaller batches, so that a very long one stays within memory
        size = max(1, min(BATCH, 60_000 // max(1, len(docs[order[min(at + BATCH, len(order)) - 1]].tokens))))
        own = [docs[i] for i in order[at : at + size]]
        x, there, begins = _padded(own, model.index)
        if there.shape[1]:
            unary = model.weights[x].sum(axis=2).astype(np.float64)
            pairs = np.array([(r, i, j) for r, d in enumerate(own) for i, j in d.skips()], dtype=np.int64).reshape(-1, 3)
            marginal = beliefs(unary, there, begins, model.steps, model.first)[0]
            if len(pairs):
                same = np.exp(model.skip * (TYPE_OF[:, None] == TYPE_OF[None, :]))
                to_j = to_i = np.ones((len(pairs), len(LABELS)))
                r, i, j = pairs.T
                for _ in range(ROUNDS):
                    # what each end believes without what the pair told it
                    new_j = (marginal[r, i] / to_i) @ same
                    new_i = (marginal[r, j] / to_j) @ same
                    to_j, to_i = new_j / new_j.max(axis=1, keepdims=True), new_i / new_i.max(axis=1, keepdims=True)
                    told = unary.copy()
                    np.add.at(told, (r, j), np.log(to_j))
                    np.add.at(told, (r, i), np.log(to_i))
                    marginal = beliefs(told, there, begins, model.steps, model.first)[0]
            best = marginal.argmax(axis=2)
            for k, i in enumerate(order[at : at + size]):
                out[i] = best[k, : len(own[k].tokens)]
        at += size
    return out


def items_of(doc: Document, labels: np.ndarray) -> list[tuple[str, str, int, int, str]]:
    """(field, type, start, end, value) of the items of a document; places are those in its parts."""
    out = []
    for k, (where, text, free) in enumerate(doc.parts):
        a, b = doc.begins[k], doc.begins[k + 1]
        i = a
        while i < b:
            kind = TYPES[TYPE_OF[labels[i]]]
            j = i + 1
            if kind in ("NAME", "ADDRESS"):
                while j < b and TYPES[TYPE_OF[labels[j]]] == kind and labels[j] != INDEX[f"{kind}_B"]:
                    j += 1
            if kind:
                s, e = i, j
                while e > s + 1 and doc.tokens[e - 1].kind == "mark" and doc.tokens[e - 1].text not in ")º°":
                    e -= 1
                while kind == "NAME" and e > s and doc.flags[s] == "title":
                    s += 1
                words = [doc.tokens[x] for x in range(s, e) if doc.tokens[x].kind != "mark"]
                digits = any(c.isdigit() for t in words for c in t.text)
                whole = len(words) and (kind != "ADDRESS" or len(words) >= 3 and digits) and (kind != "NAME" or not digits and any(len(t.low) > 2 for t in words))
                if whole:
                    start, end = doc.tokens[s].start, doc.tokens[e - 1].end
                    out.append((where, kind, start, end, text[start:end]))
            i = j
    return out


def value_type(doc: Document, labels: np.ndarray, part: int) -> str:
    """The type of a whole value: of most of its characters, if most belong to one."""
    a, b = doc.begins[part], doc.begins[part + 1]
    weight = Counter()
    for i in range(a, b):
        t = doc.tokens[i]
        if t.kind != "mark" and doc.flags[i] != "title":
            weight[TYPES[TYPE_OF[labels[i]]]] += t.end - t.start
    if not weight:
        return ""
    kind, n = weight.most_common(1)[0]
    if kind == "NAME" and (r := read(doc.parts[part][1].lower())) is not None and r["kind"] == "firm":
        return ""
    return kind if n * 2 > sum(weight.values()) else ""


def known_names(items: DataFrame) -> tuple[Names, DataFrame]:
    """The frequent first and last names, and (word, place) of all rarer ones, from (item, n) of all
    owners: a name's usual place tells which it is."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for item, n in zip(b["item"], b["n"]):
                r = read(item.lower())
                if r is None or r["kind"] not in ("person", "initial"):
                    continue
                words = [w.rstrip(".") for w in regex.split(r"[\s,]+", item.lower()) if w]
                words = [w for w in words if len(w) > 1 and w not in TITLES]
                if r["kind"] == "initial":
                    seen[(words[0], "last")] += n
                elif len(words) >= 2:
                    turned = "," in item
                    seen[(words[0], "last" if turned else "first")] += n
                    seen[(words[-1], "first" if turned else "last")] += n
            yield pd.DataFrame([(w, p, n) for (w, p), n in seen.items()], columns=["word", "place", "n"])

    per = items.mapInPandas(scan, "word string, place string, n bigint").groupBy("word").agg(F.sum(F.when(F.col("place") == "first", F.col("n")).otherwise(0)).alias("first"), F.sum("n").alias("n"))
    per = cut(per)
    total = per.agg(F.sum("n").alias("n")).collect()[0].n or 0
    out = Names()
    frequent = F.col("n") * NAME_SHARE >= total
    for r in per.where(frequent).collect():  # at most NAME_SHARE rows
        (out.first if r.first * 2 > r.n else out.last).add(r.word)
    return out, per.where(~frequent).select("word", F.when(F.col("first") * 2 > F.col("n"), "first").otherwise("last").alias("place"))


def rare_names(whole: DataFrame, rare: DataFrame) -> DataFrame:
    """(id, rare): the rare names among the words of each file, with their places, of (word, place)."""
    slot = F.crc32(F.encode("word", "UTF-8")) % FILTER_BITS
    cells = rare.groupBy(F.shiftright(slot, 5).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(crc32(encode(word, 'UTF-8')) % {FILTER_BITS} % 32 AS INT))")).alias("bits"))
    table = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for r in cells.collect():  # at most FILTER_BITS / 32 rows
        table[r.cell] = r.bits
    sent = whole.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = sent.value, {}
        for b in batches:
            rows = []
            for i, s, o, v, blank in zip(b["id"], b["content_snip"], b["owners"], b["values"], b["blank"]):
                words = {t for _, text, free in parts_of(s, o, v, blank) for t in words_of(text, not free)}
                for w in sorted(words):
                    if (may := known.get(w)) is None:
                        at = zlib.crc32(w.encode()) % FILTER_BITS
                        may = bool(int(table[at >> 5]) >> (at & 31) & 1)
                        if len(known) < 200_000:
                            known[w] = may
                    if may:
                        rows.append((i, w))
            yield pd.DataFrame(rows, columns=["id", "word"])

    facts = cut(whole.mapInPandas(scan, "id bigint, word string"))
    # words that only the filter took for names are entries too, so that none of them can be hot
    entries = facts.groupBy("word").agg(F.count("*").alias("n")).join(rare, "word", "left")
    found = lookup(facts, entries, ["word"], "n").where("place IS NOT NULL")
    return cut(found.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("word", "place"))).alias("rare")))


def words_of(text: str, any_case: bool) -> list[str]:
    """The words among ``tokens_of``, lower-cased."""
    return [m.group().lower() for m in TOKENS[any_case, "@" in text or "(at)" in text.lower()].finditer(text) if m.lastindex == 4]


def parts_of(snippet: str | None, owners: list[str] | None, entities: list[str] | None, blank: bool) -> list[tuple[str, str, bool]]:
    """(field, text, free) of a file. Entities that only blanks separate are one text."""
    parts = [("content_snip", snippet, True)] if snippet and snippet.strip() else []
    parts += [("owner_names", v, False) for v in (owners if owners is not None else [])]
    values = list(entities) if entities is not None else []
    return parts + ([("entities", " ".join(values), False)] if blank and values else [("entities", v, False) for v in values])


def document_of(snippet: str | None, owners: list[str] | None, entities: list[str] | None, blank: bool, rare: dict[str, str] | None, names: Names, known: dict[str, str]) -> Document:
    """The document of a file."""
    return Document(parts_of(snippet, owners, entities, blank), names, known, dict(rare) if rare is not None else {})


def _found(doc: Document, labels: np.ndarray, blank: bool) -> list[tuple[str, str, str]]:
    """(field, type, value) of a file, each once."""
    out = {(w, k, v) for w, k, _, _, v in items_of(doc, labels) if w == "content_snip" or (w == "entities" and blank)}
    for p, (w, text, free) in enumerate(doc.parts):
        if not free and not (w == "entities" and blank) and (kind := value_type(doc, labels, p)):
            out.add((w, kind, text))
    return sorted(out)


def _prepared(files: DataFrame, *more: str) -> tuple[DataFrame, Model]:
    """(id, content_snip, blank, owners, values, rare) of every file, with the columns ``more``, and the trained model."""
    split = cut(packed_items(files, ["owner_names", "entities"]))
    mentions = split.where("field = 'owner_names'").select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    names, rare = known_names(mentions)
    by_id = split.groupBy("id").agg(
        F.first(F.when(F.col("field") == "owner_names", F.col("items")), ignorenulls=True).alias("owners"),
        F.first(F.when(F.col("field") == "entities", F.col("items")), ignorenulls=True).alias("values"),
    )
    blank = F.coalesce(~F.col("entities").rlike(r"[,;|\t\n\"]") & ~F.trim("entities").startswith("["), F.lit(False))
    whole = files.select("id", "content_snip", blank.alias("blank"), *more).join(by_id, "id", "left")
    whole = whole.join(rare_names(whole, rare), "id", "left") if rare.limit(1).count() else whole.withColumn("rare", F.lit(None).cast("map<string,string>"))
    # two of three with numbers in their snippet, where most kinds of items are
    rich = whole.where(F.col("content_snip").rlike(r"\p{Nd}{3}")).orderBy(F.xxhash64("id"), "id").limit(TRAIN_FILES * 2 // 3)
    sample = [*rich.collect(), *whole.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(TRAIN_FILES // 3).collect()]
    docs = [document_of(r.content_snip, r.owners, r["values"], r.blank, r.rare, names, {}) for r in sample]
    return whole, train(docs, [d.weak() for d in docs], names)


def _batches(whole: DataFrame, model: Model, schema: str, make) -> DataFrame:
    sent = whole.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = sent.value, {}
        for b in batches:
            rows = []
            for a in range(0, len(b), 2000):
                c = b.iloc[a : a + 2000]
                docs = [document_of(s, o, v, bl, rare, model.names, known) for s, o, v, bl, rare in zip(c["content_snip"], c["owners"], c["values"], c["blank"], c["rare"])]
                for row, d, labels in zip(c.itertuples(index=False), docs, infer(docs, model)):
                    rows += make(row, d, labels)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return whole.mapInPandas(scan, schema)


def personal_items(files: DataFrame) -> DataFrame:
    """(id, field, pii_type, pii_value): every item of personal data of every file."""
    whole, model = _prepared(files)
    return _batches(whole, model, "id bigint, field string, pii_type string, pii_value string", lambda row, d, y: [(row.id, *x) for x in _found(d, y, row.blank)])


def redacted(text: str | None, found: list[tuple[str, str]]) -> str | None:
    """``text`` with each (type, value) replaced by its typed placeholder, the longest first. Any blanks
    may stand for those of a value, and letters of either case."""
    if text is None or not found:
        return text
    kinds = {" ".join(v.casefold().split()): k for k, v in sorted(found, key=lambda x: x[0])}
    either = "|".join(r"\s+".join(regex.escape(w) for w in v.split()) for v in sorted({v for _, v in found}, key=lambda v: (-len(v), v)))

    def placeholder(m: regex.Match) -> str:
        kind = kinds.get(" ".join(m.group().casefold().split()))
        return f"[{kind}]" if kind else m.group()

    return regex.sub(rf"(?<![\p{{L}}\p{{Nd}}])(?:{either})(?![\p{{L}}\p{{Nd}}])", placeholder, text, flags=regex.IGNORECASE)


def redacted_places(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """``text`` with each (start, end, type) replaced by its typed placeholder; they don't overlap."""
    if text is None:
        return None
    out, last = [], 0
    for start, end, kind in sorted(found):
        out += [text[last:start], f"[{kind}]"]
        last = end
    return "".join(out) + text[last:]


def in_blank_list(text: str, values: list[str], found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Places in a blank-separated ``text`` for those in its ``values`` joined by single blanks."""
    there = [(m.start(), m.end()) for m in regex.finditer(r"\S+", text)]
    at, starts = 0, []
    for v in values:
        starts.append(at)
        at += len(v) + 1
    out = []
    for start, end, kind in found:
        a, b = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
        out.append((there[a][0] + start - starts[a], there[b][0] + end - starts[b], kind))
    return out


def redacted_values(name: str, text: str | None, values: list[str] | None, found: list[tuple[str, str]]) -> str | None:
    """The packed field ``text`` with those of its ``values`` that were found replaced where they are
    written, whatever protects their characters."""
    if text is None or not found or values is None:
        return text
    there = places(name, text, list(values))
    if there is None:  # the values of another row of this id
        return redacted(text, found)
    kinds = {v: k for k, v in sorted(found)}
    out, last = [], 0
    for value, (start, end) in zip(values, there[0]):
        between = text[last:start]
        # an object may name its owner in other members than its tokens
        out.append(redacted(between, found) if there[1] else between)
        kind = kinds.get(value)
        out.append(text[start:end] if kind is None else f'"[{kind}]"' if there[1] else f"[{kind}]")
        last = end
    return "".join(out) + (redacted(text[last:], found) if there[1] else text[last:])


def redacted_files(files: DataFrame) -> DataFrame:
    """(id, content_snip, owner_names, entities): the fields of every file with placeholders in
    place of personal data, otherwise unchanged."""
    whole, model = _prepared(files, "owner_names", "entities")

    def make(row, doc: Document, labels: np.ndarray) -> list[tuple]:
        own: dict[str, list[tuple[str, str]]] = {"content_snip": [], "owner_names": [], "entities": []}
        for name, kind, value in _found(doc, labels, row.blank):
            own[name].append((kind, value))
        at = [(name, start, end, kind) for name, kind, start, end, _ in items_of(doc, labels)]
        snippet = redacted_places(row.content_snip, [x[1:] for x in at if x[0] == "content_snip"])
        values = list(row.values) if row.values is not None else []
        if not row.blank:
            entities = redacted_values("entities", row.entities, row.values, own["entities"])
        elif values == (row.entities or "").split():
            entities = redacted_places(row.entities, in_blank_list(row.entities, values, [x[1:] for x in at if x[0] == "entities"]))
        else:  # the values of another row of this id
            entities = redacted(row.entities, own["entities"])
        return [(row.id, snippet, redacted_values("owner_names", row.owner_names, row.owners, own["owner_names"]), entities)]

    return _batches(whole, model, "id bigint, content_snip string, owner_names string, entities string", make)
