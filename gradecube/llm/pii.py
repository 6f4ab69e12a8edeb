"""Operator 10: personal data replaced by keyed surrogates of the same type and format.

Numbers, addresses and secrets go through a keyed permutation of all strings of their format, so that one entity
has one surrogate everywhere and two entities never share one. Names get names of the same gender and script, made
from syllables: one for a name whatever the title before it, of the gender that most of its titles in the corpus tell.
All distinct entities then pass a check: where two of a type share a surrogate, or a surrogate is
itself an entity of the corpus, later ones try again: in their format first, then, as it may be full, in a longer one,
and in the end by a marked digest, so that the check always ends.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
EMAIL = re.compile(r"(?<![\w.%+-])[^\W_][\w.%+-]*@(?:(?:[^\W_]|-)+\.)+[^\W\d_]{2,24}(?![\w-])")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.[0-9])")
IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")
PHONE = re.compile(r"(?<![\w+.])0[1-9](?:[ .-][0-9]{2}){4}(?![\w]|[.-][0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ .-][0-9]{1,4}){3,6}(?![\w]|[.-][0-9])|(?<![\w+.,-])0[0-9]{9,10}(?![\w]|[.,-][0-9])|(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?:[ .-]?[0-9]{2,4})?(?![\w])|(?<![\w+])\+[0-9]{8,15}(?![\w])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")
KEPT = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-")
SECRET = re.compile(r"(?i)(?<![a-z])(?:api[ _-]?key|access[ _-]?key|auth|token|secret|password|passwd|passphrase|pwd)[\"']?\s*[:=]\s*[\"']?([^\s\"',;]{6,})")
#: Forms of address that tell a gender (m, f) or none (n).
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Madame": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Dr": "n", "Prof": "n", "Professor": "n", "г-н": "m", "г-жа": "f", "κ": "n"}
NAME = re.compile(r"(?<!\w)(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.? ((?:[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+)(?: [^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+)?)")
#: Syllables of made-up names by script: first, middle, and last ones for men, women, either and families.
SYLLABLES = {
    "latin": ("ba be da do fa ga ha jo ka ke la le ma mi na no pa ra ro sa so ta ti va ve wi ya zo".split(), "la le li lo ma me mi na ne ni no ra re ri ro sa se si ta te ti va ve vi".split(), {"m": "ron den lor mus rik ton".split(), "f": "lia nia ra sa tta vina".split(), "n": "len rin sel tir".split(), "family": "berg dale ford lund man ner sen son ström well".split()}),
    "cyrillic": ("ба ве да ку ла ма на па ра са та фе".split(), "ва ле ли ма ми на ни ра ро си та ти".split(), {"m": "рин мир тор лав".split(), "f": "на ла ра ина".split(), "n": "лен рин".split(), "family": "ский енко вич дзе".split()}),
    "greek": ("α βα δε κο λα μα νι πα ρα σο τι φι".split(), "κα λε λι μα νε νι ρα ρι σα τε".split(), {"m": "ος ης ας ιος".split(), "f": "ία α η ώ".split(), "n": "ις ων".split(), "family": "ίδης άκης όπου ίου".split()}),
}
#: Attempts within the entity's own format; the next ones up to MARKED are longer, from there on a marked digest stands.
OWN_FORMAT, MARKED = 4, 6


def prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key[:64]).digest(), "big")


def permuted(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of the numbers below n: ten Feistel rounds, walked until back below n."""
    if n < 2:
        return x
    half = ((n - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(10):
            f = prf(key, tweak, n, r, b)
            for k in range(1, -(-half // 512)):
                f = f << 512 | prf(key, tweak, n, r, b, k)
            a, b = b, a ^ (f & mask)
        x = a << half | b
        if x < n:
            return x


def permuted_text(text: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """text with each letter and ASCII digit moved within its class by one permutation of all texts of that format."""
    alphabets = [HEX if hexadecimal and c in HEX else DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else c if c.isascii() else neighbours(c) for c in text]
    x, n = 0, 1
    for c, alphabet in zip(text, alphabets, strict=True):
        x, n = x * len(alphabet) + alphabet.index(c), n * len(alphabet)
    x = permuted(x, n, key, f"{tweak}:{''.join(a[0] if len(a) > 1 else a for a in alphabets)}")
    out = []
    for alphabet in reversed(alphabets):
        x, k = divmod(x, len(alphabet))
        out.append(alphabet[k])
    return "".join(reversed(out))


def neighbours(c: str) -> str:
    """The letters of one case that stand near a letter outside ASCII; anything else alone."""
    if not c.isalpha():
        return c
    near = [chr(x) for x in range(ord(c) & ~63, (ord(c) | 63) + 1)]
    return "".join(x for x in near if x.isalpha() and x.islower() == c.islower() and len(x.lower()) == 1)


def luhn(digits: str) -> int:
    """What is missing from a number whose check digit is left out."""
    total = sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def valid_card(digits: str) -> bool:
    return luhn(digits[:-1]) == int(digits[-1])


def octets(text: str) -> list[int] | None:
    out = [int(x) for x in text.split(".")]
    return out if max(out) < 256 else None


def ip_kind(o: list[int]) -> str:
    if o[0] == 10 or (o[0] == 172 and 16 <= o[1] < 32) or (o[0] == 192 and o[1] == 168):
        return "private"
    return "special" if o[0] in (0, 127) or o[0] >= 224 else "public"


def ip6(text: str) -> str | None:
    """The short form of an IPv6 address with at least four digits; nothing for other texts with colons."""
    try:
        return str(ipaddress.IPv6Address(text)) if sum(c != ":" for c in text) > 3 else None
    except ValueError:
        return None


def iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return "cyrillic" if "CYRILLIC" in name else "greek" if "GREEK" in name else "latin"


def made_name(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """A name for 'given-m', 'given-f', 'given-n' or 'family'; more syllables at each attempt."""
    first, middle, last = SYLLABLES[script_of(canonical)]
    x = prf(key, "name", kind, canonical, attempt)
    ends = last[kind.rpartition("-")[2]]
    out = ""
    for part in [first, *[middle] * (2 + attempt), ends]:
        x, k = divmod(x, len(part))
        out += part[k]
    return out


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """What stands for the canonical form of an entity."""
    tweak = f"{kind}/{attempt}"
    if attempt >= MARKED:
        return f"[{kind}-{prf(key, kind, canonical, attempt) % (1 << 96):024x}]"
    more = (lambda x: x + "".join(LOWER[prf(key, tweak, canonical, k) % 26] for k in range(4 * (attempt - OWN_FORMAT + 1)))) if attempt >= OWN_FORMAT else str
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        kept = 2 if len(labels) > 1 and labels[-2] == "example" else 1
        return more(permuted_text(local, key, tweak + domain)) + "@" + ".".join([*(permuted_text(x, key, f"label/{attempt}") for x in labels[:-kept]), *labels[-kept:]])
    if kind == "ip":
        x = int.from_bytes(bytes(o := octets(canonical)), "big")
        while True:
            x = permuted(x, 1 << 32, key, tweak)
            if ip_kind(out := list(x.to_bytes(4, "big"))) == ip_kind(o):
                return ".".join(map(str, out))
    if kind == "ip6":
        head, _, rest = canonical.partition(":")
        return head + ":" + permuted_text(rest, key, tweak + head, hexadecimal=True)
    if kind == "card":
        if valid_card(canonical):
            body = canonical[0] + permuted_text(canonical[1:-1], key, tweak + canonical[0])
            return body + str(luhn(body))
        rest = canonical
        while True:
            rest = rest[0] + permuted_text(rest[1:], key, tweak + canonical[0])
            if not valid_card(rest):
                return rest
    if kind == "phone":
        code, _, rest = canonical.rpartition("/")
        own = rest
        while True:
            rest = permuted_text(rest, key, tweak + code)
            if (rest[0] == "0") == (own[0] == "0"):
                return code + "/" + rest
    if kind == "iban":
        body = permuted_text(canonical[4:], key, tweak + canonical[:2])
        return canonical[:2] + iban_check(canonical[:2], body) + body
    if kind == "secret":
        m = KEPT.match(canonical)
        head = m.group() if m else ""
        rest = canonical[len(head) :]
        hexadecimal = any(c in LOWER for c in rest)
        return head + more(permuted_text(rest, key, tweak + head, hexadecimal=hexadecimal and all(c in HEX or not c.isalnum() for c in rest)))
    if kind == "ssn":
        return permuted_text(canonical, key, tweak)
    return made_name(kind, canonical, attempt, key)


def laid_out(kind: str, original: str, value: str) -> str:
    """value in the layout and case of original; a marked digest as it is."""
    if value.startswith("[") and value.endswith("]"):
        return value
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(c for c in value if c.isalnum())
        return "".join(next(chars) if c.isalnum() else c for c in original)
    if kind in ("email", "ip6"):
        return value.upper() if original.isupper() else value
    if kind.startswith(("given", "family")):
        return value.upper() if original.isupper() and len(original) > 1 else value.capitalize() if original[0].isupper() else value
    return value


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind and canonical form of each entity of a text, in order, without overlaps."""
    out: list[tuple[int, int, str, str]] = []
    if "@" in text:
        out += [(m.start(), m.end(), "email", m.group().lower()) for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        out += [(m.start(1), m.end(1), "secret", m.group(1)) for m in SECRET.finditer(text)]
    if "::" in text or text.count(":") > 6:
        out += [(m.start(), m.end(), "ip6", form) for m in IP6.finditer(text) if (form := ip6(m.group()))]
    if re.search("[0-9]", text):
        out += [(m.start(), m.end(), "secret", m.group()) for m in KEY.finditer(text)]
        out += [(m.start(), m.end(), "ip", ".".join(map(str, octets(m.group())))) for m in IP.finditer(text) if octets(m.group())]
        out += [(m.start(), m.end(), "ssn", m.group()) for m in SSN.finditer(text)]
        for m in IBAN.finditer(text):
            plain = m.group().replace(" ", "")
            if iban_check(plain[:2], plain[4:]) == plain[2:4]:
                out.append((m.start(), m.end(), "iban", plain))
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if valid_card(digits) or (len(digits) == 16 and digits[0] in "3456"):
                out.append((m.start(), m.end(), "card", digits))
        for m in PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            code = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]{2}", m.group())
            if 9 <= len(digits) <= 15:
                code = code.group() if code else ""
                out.append((m.start(), m.end(), "phone", f"{code}/{digits[len(code) - 1 if code else 0 :]}"))
    if any(t in text for t in TITLES):
        out += names(text)
    out.sort(key=lambda e: (e[0], -e[1]))
    kept: list[tuple[int, int, str, str]] = []
    for e in out:
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept


def names(text: str) -> list[tuple[int, int, str, str]]:
    """Names after a form of address, and the same names wherever they stand in the text, capitalised or in capitals.

    The kind of a given name tells the gender of its first title here; words in small letters are not taken for names.
    """
    known: dict[str, str] = {}
    for m in NAME.finditer(text):
        parts = [p for p in m.group(2).split(" ") if p[0].isupper()]
        if not parts or len(parts) < len(m.group(2).split(" ")[:1]):
            continue
        known[parts[-1].lower()] = "family"
        if len(parts) > 1:
            known.setdefault(parts[0].lower(), "given-" + TITLES[m.group(1)])
    if not known:
        return []
    again = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(known, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
    return [(m.start(), m.end(), known[low], low) for m in again.finditer(text) if m.group()[0].isupper() and (low := m.group().lower()) in known]


def titled(text: str) -> dict[str, list[int]]:
    """How often each given name of a text follows a title for a man, and one for a woman."""
    out: dict[str, list[int]] = {}
    for m in NAME.finditer(text):
        parts = [p for p in m.group(2).split(" ") if p[0].isupper()]
        if len(parts) > 1:
            votes = out.setdefault(parts[0].lower(), [0, 0])
            votes[0] += TITLES[m.group(1)] == "m"
            votes[1] += TITLES[m.group(1)] == "f"
    return out


def plain_kind(kind: str) -> str:
    """The kind without a gender, by which entities are told apart: a name that is a family name anywhere is one person's all the same."""
    return "name" if kind.startswith(("given", "family")) else kind


def distinct_entities(docs: DataFrame) -> DataFrame:
    """kind, canonical form, shape and mixed of every entity of the corpus, once.

    The shape of a name is a family name if it ever stands as one, else a given name of the gender that more of its
    titles tell, or of none; that of anything else is its kind. mixed: some text may take it for another shape.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, str, str], list[int]] = {}
            for t in b.column(0):
                text = t.as_py() or ""
                own = entities(text)
                votes = titled(text) if any(k.startswith("given") for _, _, k, _ in own) else {}
                for k, c in {(k, c) for _, _, k, c in own}:
                    sums = found.setdefault((plain_kind(k), c, k), [0, 0])
                    if k.startswith("given"):
                        sums[0] += votes.get(c, [0, 0])[0]
                        sums[1] += votes.get(c, [0, 0])[1]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[j] for x in found], pa.string()) for j in range(3)), *(pa.array([v[j] for v in found.values()], pa.int64()) for j in range(2))], names=["kind", "canonical", "shape", "men", "women"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, canonical string, shape string, men long, women long")
    men, women = F.sum("men"), F.sum("women")
    gender = F.when(men > women, "given-m").when(women > men, "given-f").otherwise("given-n")
    family = F.max(F.col("shape") == "family")
    shape = F.when(F.col("kind") != "name", F.col("kind")).when(family, "family").otherwise(gender)
    return rows.groupBy("kind", "canonical").agg(shape.alias("shape"), (F.count_distinct("shape") > 1).alias("mixed"))


def with_surrogates(table: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, forms, shapes, _, attempts = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogate(k, c, a, key) for k, c, a in zip(shapes, forms, attempts, strict=True)], pa.string())], names=["kind", "canonical", "shape", "mixed", "attempt", "surrogate"])

    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.select("kind", "canonical", "shape", "mixed", "attempt").repartition(tasks, "kind", "canonical").mapInArrow(run, "kind string, canonical string, shape string, mixed boolean, attempt int, surrogate string")


def checked_attempts(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, canonical, shape, attempt of the entities that a text cannot settle alone: those whose first surrogate clashed, and names of mixed shape.

    In the end no two of a kind share a surrogate, nor is one an entity of it; all names are one kind. An entity that
    has tried MARKED times has a digest of 96 bits, which is no entity, so there are at most MARKED rounds.
    """
    found = stored(distinct_entities(docs))
    table = stored(with_surrogates(found.withColumn("attempt", F.lit(0)), key))
    for _ in range(MARKED):
        folded = table.withColumn("low", F.when(F.col("kind") == "name", F.lower("surrogate")).otherwise(F.col("surrogate")))
        own = F.struct("attempt", "canonical")
        holders = folded.groupBy("kind", "low").agg(F.min(own).alias("holder"), F.count("*").alias("n")).where("n > 1")
        twice = folded.join(holders, ["kind", "low"]).where(own != F.col("holder")).select("kind", "canonical")
        taken = folded.join(found.select("kind", F.col("canonical").alias("low")), ["kind", "low"], "left_semi").select("kind", "canonical")
        again = stored(twice.unionByName(taken).distinct())
        if not again.head(1):
            break
        moved = with_surrogates(table.join(again, ["kind", "canonical"], "left_semi").withColumn("attempt", F.col("attempt") + 1), key)
        table = stored(table.join(again, ["kind", "canonical"], "left_anti").unionByName(moved))
    return table.where("attempt > 0 OR mixed").select("kind", "canonical", "shape", "attempt")


def replaced(text: str, key: bytes, settled: dict[tuple[str, str], tuple[str, int]], memo: dict) -> tuple[str, list[dict]]:
    """The new text and its surrogates; settled: shape and attempt of the (kind, canonical) that the corpus decides."""
    out, at, spans, size = [], 0, [], 0
    for s, e, kind, canonical in entities(text):
        shape, attempt = settled.get((plain_kind(kind), canonical), (kind, 0))
        value = memo.get((shape, canonical, attempt))
        if value is None:
            if len(memo) > 200_000:
                memo.clear()
            value = memo[shape, canonical, attempt] = surrogate(shape, canonical, attempt, key)
        new = laid_out(kind, text[s:e], value)
        out += [text[at:s], new]
        size += s - at
        spans.append({"kind": kind, "start": size, "end": size + len(new)})
        size += len(new)
        at = e
    return ("".join([*out, text[at:]]), spans) if spans else (text, [])


def pseudonymised(docs: DataFrame, key: bytes, only_text: bool = False) -> DataFrame:
    """docs with text replaced and, unless only_text, the column entities: kind, start and end of each surrogate in the new text.

    Input: text, and any other columns, which pass unchanged (one named entities is replaced). Detected are
    e-mail addresses in any script, IPv4 and IPv6 addresses, phone, card, social security and bank account numbers, keys, tokens and passwords,
    and names after a form of address, with their other mentions in the text, capitalised or in capitals. Null texts stay null, empty ones
    empty; texts of any length are read whole; repeated rows get equal surrogates. Empty tables give no rows.
    A card keeps its first digit and check sum, a phone number its country code, an IP address its kind of range,
    a name its script, case and the gender that most of its titles in the corpus tell; every layout is kept, but IPv6
    addresses come in their short form. Where a format has too few free values, e-mail addresses
    and secrets get longer, and what still clashes is replaced by a digest in brackets. Numbers of ten or more digits
    without a break, a plus or a leading 0 are not taken for phone numbers.
    """
    clashes = checked_attempts(docs, key)
    columns = [c for c in docs.columns if only_text or c != "entities"]
    rows = docs.select(*columns)
    if clashes.head(1):
        rows = _with_attempts(rows, clashes)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = docs.select(*columns).schema
    if not only_text:
        schema = schema.add("entities", T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())))
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            extra = b.column(len(columns)) if b.num_columns > len(columns) else None
            texts, spans = [], []
            for i, t in enumerate(b.column(at)):
                text = t.as_py()
                own = {(x["kind"], x["canonical"]): (x["shape"], x["attempt"]) for x in extra[i].as_py() or []} if extra is not None else {}
                new, found = replaced(text, key, own, memo) if text is not None else (None, [])
                texts.append(new)
                spans.append(found)
            cols = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*cols, *([] if only_text else [pa.array(spans, kind)])], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def _with_attempts(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """rows with a last column of the clashing entities that their text holds, joined by a digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(d, k, c) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, c in {(plain_kind(k), c) for _, _, k, c in entities(t or "")}]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.string()) for j in range(3)], names=["digest", "kind", "canonical"])

    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    holds = rows.select(digest.alias("digest"), F.col("text").cast("string")).mapInArrow(run, "digest string, kind string, canonical string").distinct()
    lists = holds.join(clashes, ["kind", "canonical"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "canonical", "shape", "attempt")).alias("list"))
    name = "_attempts"
    while name in rows.columns:
        name += "_"
    marked = rows.withColumn(name, digest)
    return marked.join(lists, marked[name] == lists["digest"], "left").select(*[marked[c] for c in rows.columns], lists["list"].alias(name))
