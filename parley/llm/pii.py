"""Personal data: detected entities get keyed surrogates of the same type.

Emails, telephone numbers, IP addresses of both versions, payment card numbers
(15 digits with a valid check digit, or 16), account numbers (IBAN, valid), US
social security numbers, keys and tokens, and names after a title or an
introduction ("my name is") are detected in the whole text.  Numbers without a
form of their own are telephone numbers after a word that says so.  A surrogate is drawn with the key alone from the entity, so the
same entity gets the same surrogate everywhere (coreference).  It keeps script
and format: every digit or letter is replaced by one of its kind by a keyed
permutation of all strings of that format, punctuation stays, a card or account
number keeps its check digits right, an address stays an address, and a name after a title
of a man or woman is replaced by a name of that gender in that script (of any
gender after a title such as Dr).

A name that stands after a title or introduction anywhere in a text is replaced in that text
without a title too: the full name by its surrogate, the surname alone by the
last word of it.  "Mr Smith" beside "Mr John Smith" is the same person.  Names
that neither introduces in their text and first names alone are not found;
whole surrogates are distinct, their last words need not be.

Distinct entities get distinct surrogates: permutations give that by
themselves, names are drawn, and grow with each further draw.  So all distinct
entities are gathered with their surrogates; where two of a type share a
surrogate, or a surrogate is itself an entity of the corpus, all but the
smallest are drawn again with the next attempt number until none collide.

Defined results: null stays null with no entities, an empty text stays empty;
a text without entities is unchanged; repeated rows and null ids get a row
each; an empty table gives an empty result; other columns are kept, but for those
named like a result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import pieces, stored

KEY = b"parley surrogate key"  # a parameter: give your own

# Titles by the gender they tell (n: none), and syllables of the names made up.
TITLES = {"m": "Mr Mister Sir Herr Monsieur Señor Signor Senhor Господин Κύριος", "f": "Mrs Ms Miss Madam Frau Madame Mademoiselle Señora Señorita Signora Senhora Госпожа Κυρία",
          "n": "Dr Doctor Prof Professor Mx Доктор Профессор Δρ Καθηγητής"}
SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve vi za zo", "n r s l d", "a ia"),
    "cyrillic": ("ба бе бо да де до ва ве га го ка ки ко ла ле ли ло ма ми мо на не ни но па ра ре ри ро са се та те ти то", "н р с л м", "а ия"),
    "greek": ("βα βε γα γο δα δε κα κε κι κο λα λε λι μα με μι να νε νι νο πα πε ρα ρε ρι σα σε τα τε τι", "ς ν ρ", "α η"),
}
INTRODUCTIONS = "my name is|My name is|ich heiße|Ich heiße|mein Name ist|Mein Name ist|je m'appelle|Je m'appelle|me llamo|Me llamo|mi chiamo|Mi chiamo"
CALLS = "call|phone|telephone|tel|mobile|cell|fax|Call|Phone|Telephone|Tel|Mobile|Cell|Fax|Telefon|Tél|Teléfono"
GENDER = {t: g for g, names in TITLES.items() for t in names.split()}
TITLE = r"(?:" + "|".join(GENDER) + r")"
NAME = r"(?!" + TITLE + r"\b)[^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?:(?<=[\"'=:\s])|\b)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,64}|[0-9A-F]{32,64})\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "iban": r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![\w:])",
    "card": r"(?<![\d-])(?:\d{4}(?:[ -]?\d{4}){3}|3[47]\d\d[ -]?\d{6}[ -]?\d{5})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
             r"|(?<![\w.-])0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,5}(?![\d-])|\b(?:" + CALLS + r")[.:]? (?:at |on |me at )?(?P<number>\d(?:[ .-]?\d){6,14})(?![\d-])",
    "name": r"\b(?:(?:" + TITLE + r"\.? )+|(?:" + INTRODUCTIONS + r") )(?P<person>" + NAME + r"(?: " + NAME + r")?)",
}
VALID = {"iban": lambda e: iban_ok(e), "ip6": lambda e: ip6_ok(e), "card": lambda e: e[0] != "3" or len(re.sub(r"\D", "", e)) == 16 or luhn(re.sub(r"\D", "", e))}
FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
MAYBE = re.compile(r"[0-9@]|::|\b(?:" + "|".join(GENDER) + "|" + INTRODUCTIONS + r")\b|[0-9A-Fa-f]{32}")
Entity = tuple[str, str]  # type, canonical form


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, type and canonical form (of a surname: the full name)."""
    if not MAYBE.search(text):
        return
    found = []
    for m in FIND.finditer(text):
        kind = next(k for k in PATTERNS if m.group(k) is not None) if m.lastgroup not in PATTERNS else m.lastgroup
        if kind in VALID and not VALID[kind](m.group()):
            continue
        if m.group("number") is not None:  # the word before it stays
            found.append((m.start("number"), m.end("number"), kind, m.group("number")))
        elif kind == "name":
            genders = [GENDER[t] for t in re.findall(r"\w+", text[m.start():m.start("person")]) if t in GENDER]
            found.append((m.start("person"), m.end("person"), "name " + next((g for g in genders if g != "n"), "n"), m.group("person")))
        else:
            found.append((m.start(), m.end(), kind, m.group()))
    yield from with_mentions(text, found) if any(k.startswith("name") for _, _, k, _ in found) else found


def with_mentions(text: str, found: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str]]:
    """``found`` with the names brought to one form for each person, and the
    mentions of these persons without a title."""
    kinds: dict[str, list[str]] = {}
    for _, _, kind, e in found:
        if kind.startswith("name") and kind not in kinds.setdefault(e, []):
            kinds[e].append(kind)

    def person(kind: str, e: str) -> Entity:
        told = [k for k in kinds[e] if k != "name n"]
        if " " not in e:
            for full, own in kinds.items():
                if " " in full and full.split()[-1] == e and (kind in own or "name n" in (kind, *own)):
                    return person(kind if kind in own else own[0], full)
        return (told[0] if told and kind == "name n" else kind), e

    bare: dict[str, Entity] = {}
    for e, own in kinds.items():
        bare.setdefault(e, person(own[0], e))
    for e, own in kinds.items():
        bare.setdefault(e.split()[-1], person(own[0], e))
    words = sorted(bare, key=len, reverse=True)
    mention = re.compile(r"(?<!\w)(?:" + "|".join(r"\s+".join(map(re.escape, w.split())) for w in words) + r")(?!\w)")
    at = 0
    for start, end, kind, e in [*found, (len(text), len(text), "", "")]:
        for m in mention.finditer(text, at, start):
            yield m.start(), m.end(), *bare[" ".join(m.group().split())]
        if kind:
            yield start, end, *(person(kind, e) if kind.startswith("name") else (kind, e))
        at = end


def permuted(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """The place of ``x`` under a keyed permutation of range(size): a Feistel
    network on enough bits, walked until it falls in the range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(8):
            f = hashlib.blake2b(tweak + bytes([r]) + b.to_bytes((half + 7) // 8, "big"), key=key, digest_size=min(64, (half + 7) // 8 + 4)).digest()
            a, b = b, a ^ (int.from_bytes(f, "big") & mask)
        x = (a << half) | b
        if x < size:
            return x


KINDS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def reformat(text: str, key: bytes, tweak: bytes, alphabets=KINDS) -> str:
    """A permutation of all strings of the format of ``text``."""
    at = [(i, a) for i, c in enumerate(text) for a in alphabets if c in a]
    x, size = 0, 1
    for i, a in at:
        x, size = x * len(a) + a.index(text[i]), size * len(a)
    if size == 1:
        return text
    x = permuted(x, size, key, tweak + "".join(next((str(k) for k, a in enumerate(alphabets) if c in a), c) for c in text).encode())
    out = list(text)
    for i, a in reversed(at):
        x, d = divmod(x, len(a))
        out[i] = a[d]
    return "".join(out)


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 * (d > "4")) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_ok(text: str) -> bool:
    """Whether the check digits (ISO 7064, modulo 97) are right."""
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def ip6_ok(text: str) -> bool:
    """Whether it is an address of version 6; names such as ``a::b`` are none."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return any(c.isdigit() for c in text)


def script(name: str) -> str:
    c = name[0].lower()
    return "cyrillic" if "а" <= c <= "я" or c == "ё" else "greek" if "α" <= c <= "ω" else "latin"


def made_name(name: str, gender: str, key: bytes, tweak: bytes, syllables_each: int = 3) -> str:
    """As many words as ``name`` has, from syllables of its script; the last
    letters of the first word follow the gender."""
    syllables, male, female = (s.split() for s in SYLLABLES[script(name)])
    h = int.from_bytes(hashlib.blake2b(tweak + name.encode(), key=key, digest_size=32).digest(), "big")
    words = []
    for k in range(len(name.split())):
        word = ""
        for _ in range(syllables_each):
            h, d = divmod(h, len(syllables))
            word += syllables[d]
        ends = {"m": male, "f": female}.get(gender, male + female) if k == 0 else male + female
        h, d = divmod(h, len(ends))
        words.append((word + ends[d]).capitalize())
    return " ".join(words)


def surrogate(kind: str, text: str, key: bytes = KEY, attempt: int = 0) -> str:
    tweak = f"{kind}/{attempt}/".encode()
    if kind.startswith("name"):
        return made_name(text, kind[-1], key, tweak, max(3, 2 + attempt))  # each later draw is from a set many times larger
    if kind == "ip":
        return str(ipaddress.IPv4Address(permuted(int(ipaddress.IPv4Address(".".join(str(int(p)) for p in text.split(".")))), 1 << 32, key, tweak)))
    if kind == "email":
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        made = reformat(f"{local}@{host}", key, tweak)
        return f"{made}.{top}"
    if kind == "secret":
        hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)
        return reformat(text, key, tweak, ("0123456789abcdef",) if hexadecimal and text.islower() else ("0123456789ABCDEF",) if hexadecimal and text.isupper() else KINDS)
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        valid, head = luhn(digits), text[:2] if len(digits) == 15 else ""  # numbers of 15 digits begin alike
        while True:  # walk within the numbers whose check digit is as right or wrong
            text = head + reformat(text[len(head):], key, tweak + head.encode())
            if luhn(re.sub(r"\D", "", text)) == valid:
                return text
    if kind == "iban":  # the country stays; the check digits follow from the rest
        made = text[:4] + reformat(text[4:], key, tweak + text[:2].encode())
        rest = made[4:].replace(" ", "") + made[:2]
        return f"{made[:2]}{98 - int(''.join(str(int(c, 36)) for c in rest) + '00') % 97:02d}{made[4:]}"
    if kind == "ip6":
        return reformat(text, key, tweak, ("0123456789abcdef",) if text == text.lower() else ("0123456789ABCDEF",) if text == text.upper() else KINDS[:1] + ("abcdef", "ABCDEF"))
    if kind == "phone" and text.startswith("+"):
        country = re.match(r"\+\d{1,3}", text).group()
        return country + reformat(text[len(country):], key, tweak + country.encode())
    if kind == "phone" and text[0] == "0":  # a national number begins with it
        return "0" + reformat(text[1:], key, tweak + b"0")
    return reformat(text, key, tweak)


def distinct_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, entity``, each once; tasks send those of a piece once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            own = sorted({(k, e) for t in batch.column(0).to_pylist() if t for _, _, k, e in entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.string()), pa.array([x[1] for x in own], pa.string())], names=["kind", "entity"])

    return docs.select(text_col).mapInArrow(find, "kind string, entity string").distinct()


def attempts(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame | None:
    """The collision check: ``kind, entity, attempt`` of the entities whose
    first surrogate was taken, or None if there is none."""

    def draw(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [surrogate(k, e, key, a) for k, e, a in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=["kind", "entity", "attempt", "made"])
        return rows.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, made string")

    found = stored(draw(distinct_entities(docs, text_col).withColumn("attempt", F.lit(0))), "entities")
    names = found.select("kind", F.col("entity").alias("made"), F.lit(True).alias("real"))
    moved = None
    while True:  # each draw is from a set many times larger, so few rounds are needed
        # The group of a surrogate holds the few entities that share it.
        first = Window.partitionBy("kind", "made").orderBy("attempt", "entity")
        taken = found.withColumn("rank", F.row_number().over(first)).join(names, ["kind", "made"], "left").where("rank > 1 or real").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        taken = stored(taken, "taken")
        if taken.isEmpty():
            return moved
        moved = taken if moved is None else moved.join(taken, ["kind", "entity"], "left_anti").unionByName(taken)
        found = found.join(taken, ["kind", "entity"], "left_anti").unionByName(draw(taken))
        found, moved = stored(found, "entities"), stored(moved, "moved")


def replace_entities(text: str | None, key: bytes, again: dict[Entity, int], made: dict) -> tuple[str | None, list[Entity]]:
    if not text:
        return text, []
    out, at, found = [], 0, []
    for start, end, kind, e in entities(text):
        if (kind, e) not in made:
            if len(made) > 100_000:
                made.clear()
            made[kind, e] = surrogate(kind, e, key, again.get((kind, e), 0))
        whole = not kind.startswith("name") or " ".join(text[start:end].split()) == e
        out += [text[at:start], made[kind, e] if whole else made[kind, e].split()[-1]]
        at = end
        found.append((kind, e))
    return ("".join([*out, text[at:]]) if found else text), found


def pseudonymise(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text with surrogates, and ``n_entities``,
    ``n_distinct``, ``kinds`` (sorted, with commas)."""
    docs = docs.drop("n_entities", "n_distinct", "kinds", "_again", "_h")  # names of the results give way
    names = docs.columns
    moved = attempts(docs, key, text_col)
    rows = docs
    if moved is None:
        rows = rows.withColumn("_again", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        # Only documents that hold a redrawn entity get an entry, by the text's hash.
        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                own = [(h, k, e) for h, t in zip(*(c.to_pylist() for c in batch.columns)) if t for k, e in {(k, e) for _, _, k, e in entities(t) if k.startswith("name")}]
                h, k, e = zip(*own) if own else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.string()), pa.array(e, pa.string())], names=["_h", "kind", "entity"])
        rows = rows.withColumn("_h", F.xxhash64(text_col))
        kinds = [r["kind"] for r in moved.select("kind").distinct().collect()]  # at most one for each type
        held = rows.select("_h", text_col).mapInArrow(mentions if all(k.startswith("name") for k in kinds) else _all_mentions, "_h long, kind string, entity string")
        again = held.join(moved, ["kind", "entity"]).groupBy("_h").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("_again"))  # of one text
        rows = rows.join(again, "_h", "left").drop("_h")
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch in pieces(batches):
            texts, found = [], []
            for t, again in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                own = {(x["kind"], x["entity"]): x["attempt"] for x in again or ()}
                new, got = replace_entities(t, key, own, {} if own else made)
                texts.append(new)
                found.append(got)
            cols = list(batch.columns[:-1])
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([len(x) for x in found], pa.int64()), pa.array([len(set(x)) for x in found], pa.int64()), pa.array([",".join(sorted({k for k, _ in x})) for x in found], pa.string())],
                names=[*names, "n_entities", "n_distinct", "kinds"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.select(*names, "_again").mapInArrow(run, f"{schema}, n_entities long, n_distinct long, kinds string")


def _all_mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        own = [(h, k, e) for h, t in zip(*(c.to_pylist() for c in batch.columns)) if t for k, e in {(k, e) for _, _, k, e in entities(t)}]
        h, k, e = zip(*own) if own else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.string()), pa.array(e, pa.string())], names=["_h", "kind", "entity"])
