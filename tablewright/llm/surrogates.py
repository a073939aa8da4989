"""Personal data replaced by keyed surrogates of the same type and format.

Found are mail addresses, telephone numbers, IPv4 addresses, payment cards (Luhn digit),
account numbers (IBAN), secrets behind a word like token, and names behind a form of address. A surrogate is drawn from a keyed
hash of the type and the normal form of a value, so one value has one surrogate in the whole
corpus. Digits become digits, letters become letters of the same case and script, separators
stay, checksums hold again, and names keep script and gender. Names found behind a form of
address are replaced wherever else they stand in the same text.

All different values of the corpus are then compared with each other: a surrogate that two
values share, or that is itself a value of the corpus, is drawn again for all but the first.
Only such values (few) are joined back to the documents that hold them.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import words as W
from tablewright.llm.shared import drop_written, ship, written

#: Fixed lists: forms of address with the gender they tell, and given names by script and gender.
ADDRESS = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Госпожа": "f", "Κυρία": "f", "Dra": "f",
    "Dr": "n", "Doctor": "n", "Prof": "n", "Professor": "n", "Доктор": "n", "Профессор": "n",
}
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leo", "Martin", "Noah", "Oscar", "Paul"),
    ("latin", "f"): ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения"),
    ("greek", "m"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Στέφανος"),
    ("greek", "f"): ("Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"),
}
GIVEN |= {(kind, "n"): GIVEN[kind, "m"] + GIVEN[kind, "f"] for kind in ("latin", "cyrillic", "greek")}
_ALPHABET = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_TITLES = "|".join(ADDRESS)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_FINDERS = {
    "mail": re.compile(r"(?<![\w.+-])[\w.+-]*\w@\w[\w-]*(?:\.\w[\w-]*)+"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?!\w)"),
    "ip": re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w)"),
    "card": re.compile(r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)"),
    "phone": re.compile(r"(?<!\w)(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\d{3}[.-]\d{3}[.-]\d{4}(?!\w)"),
    "secret": re.compile(r"(?i:token|secret|password|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?([\w+/-]{12,})"),
    "name": re.compile(rf"(?<!\w)((?:{_TITLES})(?:\.? (?:{_TITLES}))*)\.? (" + r"[^\W\d_][\w'’-]+(?: [^\W\d_a-z][\w'’-]+)?)"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of all values, in order, without overlaps; the type listed first wins."""
    taken: list[tuple[int, int, str, str]] = []
    named: list[tuple[str, list[tuple[int, str]]]] = []

    def add(a: int, b: int, kind: str, normal: str) -> None:
        if all(b <= x or a >= y for x, y, *_ in taken):
            taken.append((a, b, kind, normal))

    digit = any(c in text for c in "0123456789")
    for kind, finder in _FINDERS.items():
        if kind == "mail" and "@" not in text or kind in ("iban", "ip", "card", "phone") and not digit:
            continue
        for m in finder.finditer(text):
            value = m[0]
            if kind == "mail":
                add(m.start(), m.end(), kind, value.lower())
            elif kind == "ip":
                add(m.start(), m.end(), kind, value)
            elif kind == "iban":
                normal = value.replace(" ", "")
                if 15 <= len(normal) <= 34 and iban_ok(normal):
                    add(m.start(), m.end(), kind, normal)
            elif kind == "secret":
                add(m.start(1), m.end(1), kind, m[1])
            elif kind == "name":
                words = [(m.start(2) + w.start(), w[0]) for w in re.finditer(r"[^ ]+", m[2])]
                words = [(a, re.sub(r"(?:['’]s)?['’-]*$", "", w)) for a, w in words[: 1 + (words[-1][1][0].isupper())]]
                if words[0][1][:1].isupper():
                    gender = next((g for t in re.findall(r"[^\W\d_]+", m[1]) if (g := ADDRESS[t]) != "n"), "n")
                    named.append((gender, words))
            else:
                normal = re.sub(r"\D", "", value)
                if kind == "card" and luhn(normal) and len(set(normal)) > 1 or kind == "phone" and 7 <= len(normal) <= 15:
                    add(m.start(), m.end(), kind, normal)
    for a, b, normal in _parts(text, named):
        add(a, b, "name", normal)
    return sorted(taken)


def _parts(text: str, named: list[tuple[str, list[tuple[int, str]]]]) -> list[tuple[int, int, str]]:
    """(start, end, normal form) of each given ('gender:name') or family name (':name') of the names
    behind a form of address, and of all further places of these in the text, with or without one."""
    if not named:
        return []
    givens: dict[str, str] = {}
    for gender, words in named:
        if len(words) > 1 and givens.get(words[0][1].lower(), "n") == "n":
            givens[words[0][1].lower()] = gender
    families = {words[-1][1].lower() for _, words in named if len(words) > 1 or words[0][1].lower() not in givens}
    out, own = [], set()
    for _, words in named:
        for k, (a, word) in enumerate(words):
            # A name alone is a family name, as behind most forms of address, unless the text has it as a given one.
            low = word.lower()
            given = k + 1 < len(words) or len(words) == 1 and low not in families
            out.append((a, a + len(word), f"{givens[low]}:{low}" if given else f":{low}"))
            own.add(a)
    names = sorted({text[a:b] for a, b, _ in out}, key=lambda n: (-len(n), n))
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, names)) + r")(?!\w)", text, re.IGNORECASE):
        low = m[0].lower()
        if m.start() in own or not m[0][0].isupper():
            continue
        # A name that is both is the family one unless a family name follows it.
        follows = re.match(r" ([^\W\d_][\w'’-]*)", text[m.end() : m.end() + 60])
        before_family = follows is not None and re.sub(r"(?:['’]s)?['’-]*$", "", follows[1]).lower() in families
        given = low in givens and (low not in families or before_family)
        if given or low in families:
            out.append((m.start(), m.end(), f"{givens[low]}:{low}" if given else f":{low}"))
    return out


class _Draw:
    """A stream of choices from a keyed hash."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{normal}\0{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        self.state, self.n = int.from_bytes(self.seed), 0

    def below(self, n: int) -> int:
        if self.state < 1 << 64:
            self.n += 1
            self.state = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4)).digest())
        self.state, choice = divmod(self.state, n)
        return choice


def script(c: str) -> str:
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


@cache
def _letters(c: str) -> str:
    """Letters of the script of c: an alphabet, else the letters of its kind near it."""
    if (own := script(c)) != "latin" or c <= "\u024f":
        return _ALPHABET[own]
    def kind(x: str) -> tuple[str, str]:
        return unicodedata.category(x), unicodedata.name(x, " ").split(" ")[0]

    first, own = ord(c) & ~0xFF, kind(c.lower())
    return "".join(x for x in map(chr, range(first, first + 256)) if kind(x) == own and x.lower() == x and len(x.upper()) == 1) or c


def _like(text: str, draw: _Draw) -> str:
    """Digits for digits (no leading zero put in), letters for letters of the same case and script."""
    out = []
    for i, c in enumerate(text):
        if c.isdecimal():
            new_number = i == 0 or not text[i - 1].isdecimal()
            out.append(str(draw.below(10)) if not new_number or c == "0" else str(1 + draw.below(9)))
        elif c.isalpha():
            letters = _letters(c)
            letter = letters[draw.below(len(letters))]
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, normal: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate's own normal form.

    Drawn again and again, it grows by a character (an address by a group) each time, so that
    there are surrogates enough however many values share a short form.
    """
    draw, more = _Draw(key, kind, normal, attempt), max(0, attempt - 1)
    if kind == "mail":
        name, _, host = normal.rpartition("@")
        name += (name[-1:] if name[-1:].isalpha() else "a") * more
        labels = host.split(".")
        return _like(name, draw) + "@" + ".".join([*(_like(x, draw) for x in labels[:-1]), labels[-1]])
    if kind == "secret":
        if set(normal) <= set("0123456789abcdef"):
            return "".join("0123456789abcdef"[draw.below(16)] for _ in normal + "0" * more)
        return _like(normal + "a" * more, draw)
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4 + more))
    if kind == "phone":
        keep = max(1, len(normal) - 10)  # the country's digits
        return normal[:keep] + _like(normal[keep:] + "1" * more, draw)
    if kind == "card":
        body = normal[0] + "".join(str(draw.below(10)) for _ in normal[1:-1] + "0" * more)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else _ALPHABET["latin"][draw.below(26)].upper() for c in normal[4:] + "0" * more)
        check = 98 - int("".join(str(int(c, 36)) for c in body + normal[:2] + "00")) % 97
        return f"{normal[:2]}{check:02d}{body}"
    gender, _, name = normal.partition(":")
    if not gender:
        return ":" + _like(name + (name[-1] if name[-1].isalpha() else "a") * more, draw)
    # Drawn again, a given name gets a second one, and so on: there are enough for all.
    names = GIVEN[script(name[0]), gender]
    return gender + ":" + "-".join(names[draw.below(len(names))] for _ in range(1 + attempt))


def render(kind: str, original: str, replacement: str) -> str:
    """The surrogate in the format of the original text: case, separators, grouping."""
    if kind == "name":
        gender, _, name = replacement.partition(":")
        if original.isupper():
            return name.upper()
        if gender:
            return name
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, name, strict=True)) if len(original) == len(name) else name.title()
    if kind == "mail":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, replacement, strict=True)) if len(original) == len(replacement) else replacement
    if kind in ("ip", "secret"):
        return replacement
    rest = iter(replacement)
    return "".join([*(next(rest) if c.isalnum() else c for c in original), *rest])


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with a value, and their different values as 'type<tab>normal form'."""
    for batch in W.pieces(batches):
        keep, values = [], []
        for i, text in enumerate(W.column(batch, "text").to_pylist()):
            found = find(text) if text else []
            if found:
                keep.append(i)
                values.append(sorted({f"{kind}\t{normal}" for *_, kind, normal in found}))
        own = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [W.column(batch, c).take(own) for c in ("doc_id", "t", "text")] + [pa.array(values, pa.list_(pa.string()))], ["doc_id", "t", "text", "values"])


def _untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that `_detected` leaves out, as result rows."""
    for batch in W.pieces(batches):
        own = pa.array([i for i, text in enumerate(W.column(batch, "text").to_pylist()) if not text or not find(text)], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [W.column(batch, "doc_id").take(own), pa.array([0] * len(own), pa.int64()), pa.array([""] * len(own), pa.string()), W.column(batch, "text").take(own)],
            ["doc_id", "n_found", "types", "text"])


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(W.column(batch, "value").to_pylist(), W.column(batch, "attempt").to_pylist(), strict=True)
            out = [(v.partition("\t")[0], v.partition("\t")[2], a) for v, a in rows]
            yield pa.RecordBatch.from_arrays(
                [W.column(batch, "value"), W.column(batch, "attempt"), pa.array([f"{k}\t{surrogate(k, n, key, a)}" for k, n, a in out], pa.string())],
                ["value", "attempt", "surrogate"])
    return run


def _replaced(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text, tries in zip(W.column(batch, "text").to_pylist(), W.column(batch, "tries").to_pylist(), strict=True):
                again = {x["value"]: x["attempt"] for x in tries or ()}
                out, at, found = [], 0, find(text)
                for a, b, kind, normal in found:
                    out += [text[at:a], render(kind, text[a:b], surrogate(kind, normal, key, again.get(f"{kind}\t{normal}", 0)))]
                    at = b
                texts.append("".join([*out, text[at:]]))
                counts.append(len(found))
                kinds.append(",".join(sorted({x[2] for x in found})))
            yield pa.RecordBatch.from_arrays(
                [W.column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_found", "types", "text"])
    return run


def assigned(values: DataFrame, key: bytes) -> DataFrame:
    """value, attempt, surrogate for distinct values, no surrogate twice and none a value itself."""
    now = written(values.withColumn("attempt", F.lit(0)).mapInArrow(_drawn(key), "value string, attempt int, surrogate string"), "surrogates")
    while True:
        shared = now.groupBy("surrogate").agg(F.count("*").alias("n"), F.min("value").alias("first")).filter("n > 1").select("surrogate", "first")
        own = now.select(F.col("value").alias("surrogate"), F.lit(True).alias("is_value"))
        marked = now.join(shared, "surrogate", "left").join(own, "surrogate", "left").withColumn(
            "again", F.coalesce(F.col("is_value"), F.lit(False)) | F.coalesce(F.col("first") != F.col("value"), F.lit(False)))
        bad = written(marked.filter("again").select("value", F.col("attempt") + 1), "again")
        if not bad.take(1):
            drop_written(bad)
            return now
        redone = bad.toDF("value", "attempt").mapInArrow(_drawn(key), "value string, attempt int, surrogate string")
        before, now = now, written(now.join(bad.select("value"), "value", "left_anti").unionByName(redone), "surrogates")
        drop_written(before)
        drop_written(bad)


def replace_personal_data(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", all_rows: bool = False) -> DataFrame:
    """doc_id, n_found, types and the new text of every row whose text holds personal data.

    Rows without any are returned, unchanged, with `all_rows` only. Given and family names have
    their own surrogates, so full and short forms of a name agree; each counts as one. Missing and empty texts hold
    none. Repeated rows are replaced alike; rows without an id are replaced too. One value has
    the same surrogate everywhere, different values have different ones, and no surrogate is
    a value that the corpus holds; whoever has the key can draw the same ones, so keep it. Other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    secret = key.encode()
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("t", F.xxhash64("doc_id", "text"))
    found = written(texts.mapInArrow(_detected, "doc_id long, t long, text string, values array<string>"), "detected")
    held = found.select("t", F.explode("values").alias("value"))
    tries = assigned(held.select("value").distinct(), secret).filter("attempt > 0").select("value", "attempt")
    again = held.distinct().join(tries, "value").groupBy("t").agg(F.collect_list(F.struct("value", "attempt")).alias("tries"))
    schema = "doc_id long, n_found long, types string, text string"
    out = found.select("doc_id", "t", "text").join(again, "t", "left").mapInArrow(_replaced(secret), schema)
    return out.unionByName(texts.select("doc_id", "text").mapInArrow(_untouched, schema)) if all_rows else out
