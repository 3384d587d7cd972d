"""One form of writing for texts that look the same.

The tokens of the collection are its vocabulary. Its clean spellings, words in
one alphabet without odd forms, are held in tries, and every token with a sign
beyond ASCII is run through its trie by a weighted edit automaton: look-alikes
(full-width forms, ligatures, letters of other alphabets with the same shape),
joined and split accents and signs that don't show cost nothing, every other
edit costs one. With no cost allowed it ends on the spellings that look the
same, and the first of them is the canonical one. A sign with two looks (a
stroke that may be an I or an l) is told by the words that the collection has.

A token that matches no spelling, and all between tokens, is normalized by
table: the look-alike letters of a word in one foreign alphabet are given back
to that alphabet, others become Latin. What a reader can see stays: case,
accents, raised and lowered signs.

The vocabulary is sharded by a key that all spellings of a look share, so a
trie never holds more than its shard, and the tries of a collection are worked
by many tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.session import materialize

# Letters and signs of other alphabets or blocks with the shape of a Latin letter or ASCII sign.
LOOK_ALIKES = {
    "a": "аɑ",
    "c": "сⅽϲ",
    "d": "ԁⅾ",
    "e": "еҽ",
    "g": "ɡ",
    "h": "һ",
    "i": "іⅰ",
    "j": "јϳ",
    "l": "ⅼ",
    "m": "ⅿ",
    "o": "оοօ",
    "p": "рρ",
    "q": "ԛ",
    "s": "ѕ",
    "u": "ս",
    "v": "ⅴѵ",
    "w": "ԝ",
    "x": "хⅹ",
    "y": "у",
    "A": "АΑ",
    "B": "ВΒ",
    "C": "СⅭϹ",
    "D": "Ⅾ",
    "E": "ЕΕ",
    "G": "Ԍ",
    "H": "НΗ",
    "I": "ІΙⅠӀ",
    "J": "ЈͿ",
    "K": "КΚK",
    "L": "Ⅼ",
    "M": "МΜⅯ",
    "N": "Ν",
    "O": "ОΟՕ",
    "P": "РΡ",
    "Q": "Ԛ",
    "S": "ЅՏ",
    "T": "ТΤ",
    "V": "ⅤѴ",
    "W": "Ԝ",
    "X": "ХΧⅩ",
    "Y": "ҮΥ",
    "Z": "ΖZ",
    "-": "‐‑﹣⁃",
    "'": "ʹʼ",
    ";": ";",
    "æ": "ӕ",
    "Æ": "Ӕ",
    "ə": "ә",
    "Ə": "Ә",
    "Å": "Å",
    "Ω": "Ω",
    "·": "·",
}
# The same for Cherokee, Coptic, Deseret and small capitals.
OTHER_LOOK_ALIKES = {
    "A": "ᎪⲀ",
    "B": "ᏴⲂ",
    "C": "ᏟⲤ𐐕",
    "D": "Ꭰ",
    "E": "Ꭼ",
    "G": "Ꮐ",
    "H": "ᎻⲎ",
    "I": "Ⲓ",
    "J": "Ꭻ",
    "K": "ᏦⲔ",
    "L": "Ꮮ",
    "M": "ᎷⲘ",
    "N": "Ⲛ",
    "O": "Ⲟ𐐄",
    "P": "ᏢⲢ",
    "R": "Ꮢ",
    "S": "Ꮪ",
    "T": "ᎢⲦ",
    "V": "Ꮩ",
    "W": "Ꮃ",
    "X": "Ⲭ",
    "Y": "Ⲩ",
    "Z": "ᏃⲌ",
    "c": "ⲥᴄ𐐽",
    "o": "ⲟᴏ𐐬",
    "p": "ⲣ",
    "s": "ꜱ𐑈",
    "u": "ᴜ",
    "v": "ᴠ",
    "w": "ᴡ",
    "z": "ᴢ",
}
# Letters with several looks; the first is the table's.
SEVERAL_LOOKS = {"Ӏ": "Il", "ӏ": "lI", "ǀ": "lI"}
#: Kinds of space, beside those of category Zs.
SPACES = "    　"
#: Characters without width, beside those of category Cf.
IGNORABLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"


#: Parts of Unicode that the fold leaves alone: ideographs, Hangul, Yi, private use.
_UNTOUCHED = ((0x3400, 0xA4D0), (0xAC00, 0xD7A4), (0xD800, 0xF900), (0x12000, 0x1B000), (0x20000, 0xE0000), (0xE01F0, 0x110000))
#: Mathematical letters in the shape of plain ones; bold, slanted and ornate ones show.
_PLAIN_MATH = re.compile(r"MATHEMATICAL (?:SANS-SERIF|MONOSPACE) (?:CAPITAL|SMALL|DIGIT) \w+")


def _table() -> dict[int, str]:
    """Every character that the fold changes, by rule or by the tables of look-alikes."""
    table: dict[int, str] = {}
    at = 0x80
    while at < 0x110000:
        jump = next((high for low, high in _UNTOUCHED if low <= at < high), None)
        if jump is not None:
            at = jump
            continue
        ch = chr(at)
        category = unicodedata.category(ch)
        if category == "Cf" or ch in IGNORABLE or 0xFE00 <= at <= 0xFE0F or 0xE0100 <= at <= 0xE01EF:
            table[at] = ""
        elif category == "Zs" or ch in SPACES:
            table[at] = " "
        else:
            kind, _, parts = unicodedata.decomposition(ch).partition(" ")
            name = unicodedata.name(ch, "") if kind in {"<compat>", "<font>"} else ""
            # Ligatures, digraphs and Roman numbers are letters made of several; raised, circled and fraction forms show.
            joined = kind == "<compat>" and " " in parts and category[0] in "LN" and ("LIGATURE" in name or "ROMAN NUMERAL" in name or re.fullmatch(r"LATIN (?:CAPITAL|SMALL) LETTER (?:DZ|LJ|NJ)(?: WITH CARON)?|LATIN CAPITAL LETTER [DLN] WITH SMALL LETTER [ZJ](?: WITH CARON)?", name))
            if kind in {"<wide>", "<narrow>"} or joined or kind == "<font>" and _PLAIN_MATH.fullmatch(name):
                table[at] = unicodedata.normalize("NFKC", ch)
        at += 1
    for looks in (LOOK_ALIKES, OTHER_LOOK_ALIKES):
        for plain, others in looks.items():
            for ch in others:
                table[ord(ch)] = plain
    for ch, looks in SEVERAL_LOOKS.items():
        table[ord(ch)] = looks[0]
    return table


_TABLE = _table()


def folded_signs(fold=None) -> list[int]:
    """Code points beyond ASCII that a fold changes by themselves: those of its table, and joined letters over one of them."""
    fold = fold or globals()["fold"]
    out, at = [], 0x80
    while at < 0x110000:
        jump = next((high for low, high in _UNTOUCHED if low <= at < high), None)
        if jump is None and fold(chr(at)) != unicodedata.normalize("NFC", chr(at)):
            out.append(at)
        at = jump or at + 1
    return out


def _caseless() -> dict[int, str]:
    """The fold for words in which case doesn't count either: look-alike and case classes merged."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.get(c, c) != c:
            c = root[c]
        return c

    def join(a: str, b: str) -> None:
        a, b = find(a), find(b)
        if a != b:
            low, high = sorted((a, b), key=lambda c: (not ("a" <= c <= "z"), c))
            root[high] = low

    for plain, others in (*LOOK_ALIKES.items(), *OTHER_LOOK_ALIKES.items()):
        for ch in (plain, *others):
            join(plain, ch)
            if len(ch.lower()) == 1:
                join(ch, ch.lower())
            if len(plain.lower()) == 1:
                join(plain, plain.lower())
    table = dict(_TABLE)
    for c in list(root):
        table[ord(c)] = find(c)
    return {k: v for k, v in table.items() if chr(k) != v}


_CASELESS = _caseless()
#: What can change when a text is folded: a run beyond ASCII, with the letter before it that marks may join.
_RUN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")


class _Folded(dict):
    """Folded runs; texts repeat them, so few are made."""

    def __init__(self, table: dict[int, str]):
        super().__init__()
        self.table = table

    def __missing__(self, run: str) -> str:
        if len(self) > 200_000:
            self.clear()
        # Taken apart first, so that a look-alike with an accent meets the accented plain letter.
        self[run] = out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", run).translate(self.table))
        return out

    def of(self, m: re.Match) -> str:
        return self[m[0]]


_FOLDED, _FOLDED_CASELESS = _Folded(_TABLE), _Folded(_CASELESS)


def fold(text: str) -> str:
    """The look of a text by table: equal for texts that a reader can't tell apart."""
    if not text.isascii():
        text = _RUN.sub(_FOLDED.of, text)
    return text.replace("\r\n", "\n") if "\r" in text else text


def fold_caseless(text: str) -> str:
    """`fold` in lower case, with letters that look alike in either case merged."""
    text = text.lower()
    return text if text.isascii() else _RUN.sub(_FOLDED_CASELESS.of, text)


#: Signs without width and marks that a token may hold beside its letters.
_INSIDE = "".join(sorted(chr(c) for c, to in _TABLE.items() if to == "" and c < 0xE0000)) + "̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"

#: A run without a sign of ASCII but letters; texts repeat them, so what is in one is found once.
_CHUNK = re.compile("[A-Za-z\x80-\U0010ffff]+")
#: In such a run: a token, which is a longest run of letters, marks and signs without width, or another sign.
_PART = re.compile(rf"((?:[^\W\d_]+|[{_INSIDE}]+)+)|[^A-Za-z]")
#: For texts of ASCII alone: everything but letters is a space.
_TO_WORDS = bytes(c if chr(c).isalpha() and c < 0x80 else 0x20 for c in range(256))


class _Tokens(dict):
    """The tokens of a run."""

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        self[chunk] = found = (chunk,) if chunk.isascii() else tuple(t for m in _PART.finditer(chunk) if (t := m[1]))
        return found


_TOKENS = _Tokens()


def odd_tokens(body: str) -> list[str]:
    """The tokens of a text that are not all ASCII, in order."""
    return [t for chunk in _CHUNK.findall(body) if not chunk.isascii() for t in _TOKENS[chunk] if not t.isascii()]


def look(token: str) -> str:
    """How a token looks, by table: letters of other alphabets as Latin ones where they have the same shape."""
    return token if token.isascii() else _FOLDED[token]


def _alphabet(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ", 1)[0]


def _own_letters() -> dict[str, dict[str, str]]:
    """Alphabet -> Latin letter -> the letter of that alphabet with its shape."""
    out: dict[str, dict[str, str]] = {}
    for plain, others in (*LOOK_ALIKES.items(), *OTHER_LOOK_ALIKES.items()):
        for ch in others:
            if unicodedata.category(ch)[0] == "L" and (script := _alphabet(ch)) != "LATIN":
                out.setdefault(script, {}).setdefault(plain, ch)
    return out


_OWN_LETTERS = _own_letters()
#: Signs that no clean spelling holds: all that the table changes but letters of other alphabets.
_ODD_FORMS = frozenset(c for c in map(chr, _TABLE) if not (unicodedata.category(c)[0] == "L" and any(c in others for others in (*LOOK_ALIKES.values(), *OTHER_LOOK_ALIKES.values())) and _alphabet(c) != "LATIN")) | set(SEVERAL_LOOKS)


class _ByTable(dict):
    """Tokens normalized by table; a word with letters of one foreign alphabet alone is written in it throughout."""

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        out = seen = look(token)
        if not seen.isascii():
            apart = unicodedata.normalize("NFD", seen)
            scripts = {_alphabet(c) for c in apart if unicodedata.category(c)[0] == "L"} - {"LATIN"}
            own = _OWN_LETTERS.get(next(iter(scripts)), {}) if len(scripts) == 1 else {}
            if own and all(c in own or unicodedata.category(c)[0] != "L" or _alphabet(c) != "LATIN" for c in apart):
                out = unicodedata.normalize("NFC", "".join(own.get(c, c) for c in apart))
        self[token] = out
        return out


by_table = _ByTable().__getitem__


def clean(token: str) -> bool:
    """Whether a token can serve as a spelling: ASCII, or in one alphabet, with joined accents and no sign that doesn't show."""
    if token.isascii():
        return True
    if not unicodedata.is_normalized("NFC", token) or not _ODD_FORMS.isdisjoint(token):
        return False
    used = {_alphabet(c) for c in token if unicodedata.category(c)[0] == "L"}
    # A Latin word must look as it is written; a foreign one may have letters that look Latin.
    return len(used) == 1 and (used != {"LATIN"} or look(token) == token)


def key_of(token: str) -> str:
    """The same for all tokens that the automaton could take for one another at no cost."""
    return look(token).replace("I", "l")


class Spellings:
    """A trie of spellings by their looks, and the weighted edit automaton that runs over it."""

    __slots__ = ("root", "budget", "seen")

    def __init__(self, words: Iterable[tuple[str, object]], cost: int = 0):
        """`words`: (spelling, its rank; the least wins among spellings at the same cost). `cost` is what edits may cost in all."""
        self.root: dict = {}
        self.budget = cost
        self.seen: dict[str, str | None] = {}
        for word, rank in words:
            node = self.root
            for ch in unicodedata.normalize("NFD", look(word)):
                node = node.setdefault(ch, {})
            node[""] = min(node.get("", (rank, word)), (rank, word))

    def match(self, token: str) -> str | None:
        """The best spelling within the allowed cost, or None."""
        if token in self.seen:
            return self.seen[token]
        # A state is a node with what it has cost: edits, and looks taken that are not a sign's first.
        states = self._inserted({id(self.root): (self.root, (0, 0))})
        for ch in unicodedata.normalize("NFD", token):
            after: dict[int, tuple[dict, tuple[int, int]]] = {}
            looks = SEVERAL_LOOKS.get(ch) or [_TABLE.get(ord(ch), ch)]
            for node, (spent, other) in states.values():
                for place, seen in enumerate(looks):
                    self._read(after, node, unicodedata.normalize("NFD", seen), (spent, other + (place > 0)))
                if spent < self.budget:
                    self._reach(after, node, (spent + 1, other))  # the sign is left out
                    for label, child in node.items():
                        if label:
                            self._reach(after, child, (spent + 1, other))  # another stands for it
            states = self._inserted(after)
            if not states:
                break
        ends = [(cost, node[""]) for node, cost in states.values() if "" in node]
        found = min(ends)[1][1] if ends else None
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[token] = found
        return found

    def _read(self, after: dict, node: dict, seen: str, cost: tuple[int, int]) -> None:
        """Follow a look through the trie; one without signs stays where it is."""
        for c in seen:
            node = node.get(c)
            if node is None:
                return
        self._reach(after, node, cost)

    @staticmethod
    def _reach(after: dict, node: dict, cost: tuple[int, int]) -> None:
        held = after.get(id(node))
        if held is None or cost < held[1]:
            after[id(node)] = (node, cost)

    def _inserted(self, states: dict) -> dict:
        """With the states that signs of the trie, not in the token, lead to."""
        ahead = list(states.values())
        while ahead:
            node, (spent, other) = ahead.pop()
            if spent < self.budget:
                for label, child in node.items():
                    if label and (id(child) not in states or (spent + 1, other) < states[id(child)][1]):
                        states[id(child)] = (child, (spent + 1, other))
                        ahead.append(states[id(child)])
        return states


#: Distinct tokens that a task holds before it hands them on.
TOKENS_AT_A_TIME = 200_000


def token_counts(texts: DataFrame, text: str) -> DataFrame:
    """(key, token, ascii, n) of the tokens of the collection: in how many texts each occurs.

    Tokens are combined inside a task; one may come in several rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        plain: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            for word, n in plain.items():
                held[word.decode("ascii")] = held.get(word.decode("ascii"), 0) + n
            plain.clear()
            words = [w for w in held if w.isascii() or by_table(w)]
            batch = pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in words], pa.string()), pa.array(words, pa.string()), pa.array([w.isascii() for w in words], pa.bool_()), pa.array([held[w] for w in words], pa.int64())], names=["key", "token", "ascii", "n"])
            held.clear()
            return batch

        for batch in batches:
            for body in batch.column(0).to_pylist():
                if body is None:
                    continue
                if body.isascii():
                    for word in set(body.encode("ascii").translate(_TO_WORDS).split()):
                        plain[word] = plain.get(word, 0) + 1
                else:
                    for word in {t for chunk in set(_CHUNK.findall(body)) for t in _TOKENS[chunk]}:
                        held[word] = held.get(word, 0) + 1
                if len(held) + len(plain) > TOKENS_AT_A_TIME:
                    yield flush()
        yield flush()

    return texts.select(F.col(text)).mapInArrow(count, "key string, token string, ascii boolean, n bigint")


#: Tokens in one trie shard; a token takes about two kilobytes there.
SHARD = 50_000


def canonical_spellings(texts: DataFrame, text: str, shard: int = SHARD) -> DataFrame:
    """(token, spelling): the canonical spelling of every token beyond ASCII that matches one and that the table writes otherwise.

    Of the spellings that a token matches, those by the first look of its signs
    come first, then ASCII ones, then those in most texts, then the least.
    """
    counted = materialize(token_counts(texts, text), "tokens")
    # Only words that look like a token beyond ASCII go on; the others need no trie.
    odd = counted.where("not ascii").select("key").distinct()
    words = materialize(counted.join(odd, "key", "left_semi").groupBy("key", "token").agg(F.sum("n").alias("n")), "vocabulary")
    shards = max(1, -(-words.count() // shard))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            counts.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        spellings = Spellings((w, (not w.isascii(), -n)) for w, n in counts.items() if clean(w))
        found = [(w, s) for w in counts if not w.isascii() and (s := spellings.match(w)) is not None and s != by_table(w)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], names=["token", "spelling"])

    return words.repartition(shards, "key").select("token", "n").mapInArrow(resolve, "token string, spelling string")


#: Spellings sent to every task at a time; beyond that the texts are passed over in blocks.
SPELLINGS_AT_A_TIME = 500_000


def canonical_texts(texts: DataFrame, key: list[str], text: str, spellings: DataFrame | None = None, at_a_time: int = SPELLINGS_AT_A_TIME) -> DataFrame:
    """`key` columns, `text` and `canonical`: the text in its one form of writing.

    A null text stays null and an empty one empty; key columns may bear any
    name but `canonical` and `__spelled`. The spellings are those of the collection unless
    given. They are sent to the tasks in blocks of at most `at_a_time`, each
    block a pass without shuffle; a token is in one block only, so the number
    of blocks does not change the result.
    """
    if spellings is None:
        spellings = materialize(canonical_spellings(texts, text), "spellings")
    total = spellings.count()
    blocks = max(1, -(-total // at_a_time))
    out = texts.select(*key, F.col(text).alias(text), F.lit(None).cast("map<int,string>").alias("__spelled"))
    for i in range(blocks):
        block = spellings.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == i)
        sent = out.sparkSession.sparkContext.broadcast({r.token: r.spelling for r in block.toLocalIterator()})
        if i + 1 < blocks:
            out = out.mapInArrow(_spelled(text, sent), out.schema)
    done = out.select(*key, text, "__spelled").withColumn("canonical", F.lit(None).cast("string"))
    return done.mapInArrow(_written(text, sent), done.schema).drop("__spelled")


def _spelled(text: str, sent):
    """Note the spellings of a block by the places of their tokens in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            at = batch.schema.get_field_index("__spelled")
            made = []
            for body, held in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(at).to_pylist()):
                found = [] if body is None or body.isascii() else [(i, known[t]) for i, t in enumerate(odd_tokens(body)) if t in known]
                made.append([*(held or []), *found] or None)
            columns = list(batch.columns)
            columns[at] = pa.array(made, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def _written(text: str, sent):
    """Write the texts: tokens by their spelling, or else by table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(sent.value)
        for batch in batches:
            at = batch.schema.get_field_index("canonical")
            bodies, spelled = batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index("__spelled")).to_pylist()
            columns = list(batch.columns)
            columns[at] = pa.array([None if b is None else writer.write(b, dict(m) if m else None) for b, m in zip(bodies, spelled)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


class Writer(dict):
    """Writes texts in their one form; holds the runs that it has written."""

    def __init__(self, known: dict[str, str]):
        super().__init__()
        self.known = known

    def __missing__(self, chunk: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[chunk] = out = chunk if chunk.isascii() else _PART.sub(lambda m: self._token(m[1]) if m[1] else _FOLDED[m[0]], chunk)
        return out

    def _token(self, token: str) -> str:
        return token if token.isascii() else self.known.get(token) or by_table(token)

    def write(self, body: str, by_place: dict[int, str] | None = None) -> str:
        """A text in its one form of writing; `by_place` has spellings by the place of a token among those beyond ASCII."""
        if "\r" in body:
            body = body.replace("\r\n", "\n")
        if body.isascii():
            return body
        if not by_place:
            return unicodedata.normalize("NFC", _CHUNK.sub(lambda m: self[m[0]], body))
        place = -1

        def token(m: re.Match) -> str:
            nonlocal place
            if m[1] is None:
                return _FOLDED[m[0]]
            place += not m[1].isascii()
            return by_place.get(place) or self._token(m[1]) if not m[1].isascii() else m[1]

        return unicodedata.normalize("NFC", _CHUNK.sub(lambda m: m[0] if m[0].isascii() else _PART.sub(token, m[0]), body))
