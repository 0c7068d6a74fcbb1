"""Personal data in texts, by weak supervision: labelers vote, their reliability is estimated, a classifier decides.

Candidates are the matches of the base patterns and of looser ones (failing base matches, numbers inside
longer ones, other notations, credentials). On each candidate seven labelers vote for, against, or not at all: three
by pattern (the base rule, a check of the value, its form), two by gazetteer (known issuers, numbering plans,
domains and reserved networks; names of credentials) and two by context (cue words before it, what
touches it). The votes of all candidates of the corpus are counted by pattern of votes (at most 3 ** 7 a kind, so the
driver reads a table of bounded size), and expectation-maximisation on these counts estimates how often
each labeler is right on true and on false candidates. The posteriors of a bounded sample (``SAMPLE``, the smallest
checksums) train a logistic span classifier on form and context by gradient descent; it scores every candidate. Base matches
stay whatever it says; other candidates stay from a score of one half on, if they overlap none that stays already.

Kinds are email, ip, card and phone, and secret (credentials), which has no base pattern. All patterns
take time in proportion to the text. Null texts are empty; places are code points.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paidup.llm.session import prepared
from paidup.workspace import Workspace

KINDS = ("email", "ip", "card", "phone", "secret")
#: Most candidates that the classifier is trained on.
SAMPLE = 20_000
#: Features are hashed into so many weights.
WEIGHTS = 1 << 12
ACCEPTED = 0.5

# --- fixed values: gazetteers ------------------------------------------------------------------

DOMAINS = set("com org net edu gov mil int info biz io co de fr es it nl uk us ca au br ch at be se no pl eu ru jp cn in".split())
CALLING_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66".split()) | set(
    "81 82 84 86 90 91 92 93 94 95 98".split()
)
ISSUERS = re.compile("3[47]|30[0-5]|3[689]|35|4|5[1-5]|2[2-7]|6011|64[4-9]|65|62")
RESERVED = re.compile(r"0+\.|0*10\.|0*127\.|0*169\.0*254\.|0*192\.0*168\.|0*172\.0*(1[6-9]|2[0-9]|3[01])\.|0*(22[4-9]|2[3-5][0-9])\.")
CREDENTIALS = re.compile("(token|secret|passw(or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential)s?[\"']?\\s*[:=]?\\s*[\"']?$")
CUES = {
    "email": re.compile("e-?mail|mailto|contact|write to|correo|courriel"),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|dirección"),
    "card": re.compile("card|visa|master ?card|amex|credit|debit|tarjeta|carte|karte"),
    "phone": re.compile(r"\btel|phone|call|mobile|fax|whatsapp|llame|appel|anruf"),
    "secret": re.compile("token|secret|passw|pwd|key|credential|bearer"),
}
OTHER_CUES = re.compile(r"isbn|issn|doi|order|invoice|version|\bv$|section|§|chapter|page|serial|build|release|article|arxiv|commit|\brev")

# --- candidates --------------------------------------------------------------------------------

_WORTH_READING = r"[0-9@]|(?i:token|secret|passw|pwd|api.?key|[\[(] ?at ?[\])])"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile("[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"[\[(] ?(?:at|AT) ?[\])]")
_HIDDEN_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{1,63})+"
)
_IPV6 = re.compile(
    "(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
)
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NAMED_SECRET = re.compile(
    "(?i:token|secret|password|passwd|pwd|(?:api|access|private)[_ -]?key)s?[\"']?\\s{0,2}[:=]\\s{0,2}[\"']?([A-Za-z0-9+/_.=-]{8,})"
)
_HEX_SECRET = re.compile("(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])")


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = int(x) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Every address is sought from its @, so that a long run without one is not read again from each place."""
    end, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in _LOCAL:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            end = domain.end()
            yield first, end, True
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four numbers at a time of every dotted sequence."""
    for sequence in _DOTTED.finditer(text):
        parts = sequence.group().split(".")
        at = sequence.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            yield at, at + size, all(map(_small, four))
            at += size + 1


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for number in _DIGITS.finditer(text):
        digits = re.sub("[ -]", "", number.group())
        if 13 <= len(digits) <= 19:
            yield number.start(), number.end(), luhn(digits)
        elif len(digits) > 19:
            yield from _cards_within(number.group(), number.start())


def _cards_within(number: str, at: int) -> Iterator[tuple[int, int, bool]]:
    """Parts of a longer number that could be cards: 13 to 19 digits in one, or four times four."""
    parts = [(m.start() + at, m.end() + at) for m in re.finditer("[0-9]+", number)]
    i = 0
    while i < len(parts):
        start, end = parts[i]
        if 13 <= end - start <= 19:
            yield start, end, False
        elif i + 4 <= len(parts) and all(b - a == 4 for a, b in parts[i : i + 4]):
            yield start, parts[i + 3][1], False
            i += 3
        i += 1


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _PHONE.finditer(text):
        yield m.start(), m.end(), 9 <= sum(x.isdigit() for x in m.group()) <= 15


def _all(pattern: re.Pattern, group: int = 0):
    return lambda text: ((m.start(group), m.end(group), False) for m in pattern.finditer(text))


def _hidden_emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Addresses with a bracketed "at", read only where a text has one."""
    return _all(_HIDDEN_EMAIL)(text) if _AT.search(text) else iter(())


_FINDERS = {
    "email": (_emails, _hidden_emails),
    "ip": (_addresses, _all(_IPV6)),
    "card": (_cards,),
    "phone": (_phones, _all(_LOCAL_PHONE)),
    "secret": (_all(_NAMED_SECRET, 1), _all(_HEX_SECRET)),
}

Candidate = tuple[str, int, int, bool]


def candidates(text: str) -> list[Candidate]:
    """(kind, start, end, base) by kind and start. Base ones are the matches of the base patterns that pass, and the
    others do not overlap them."""
    found: dict[tuple[str, int, int], bool] = {}
    for kind, finders in _FINDERS.items():
        for finder in finders:
            for start, end, base in finder(text):
                found[kind, start, end] = found.get((kind, start, end), False) or base
    taken = Taken([(start, end) for (_, start, end), base in found.items() if base])
    out = [(kind, start, end, base) for (kind, start, end), base in found.items() if base or taken.free(start, end)]
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1:]))


class Taken:
    """Stretches of a text that spans hold; those given at first may overlap."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return not i or self.ends[i - 1] <= start

    def take(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, end)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


# --- labelers: 1 for, 0 against, None no vote ----------------------------------------------------


@dataclass(frozen=True)
class Sight:
    """A candidate as the labelers see it."""

    kind: str
    value: str
    base: bool
    before: str  # up to 40 characters, lower case
    left: str  # the character that touches it, or empty
    right: str
    digits: str = field(default="")


def sight(text: str, candidate: Candidate) -> Sight:
    kind, start, end, base = candidate
    value = text[start:end]
    return Sight(
        kind, value, base, text[max(start - 40, 0) : start].lower(), text[start - 1 : start] if start else "", text[end : end + 1],
        "".join(x for x in value if x.isascii() and x.isdigit()),
    )


def base_rule(x: Sight) -> int | None:
    return None if x.kind == "secret" else int(x.base)


def value_check(x: Sight) -> int | None:
    if x.kind == "card":
        return int(luhn(x.digits))
    if x.kind == "ip":
        return int("." not in x.value or all(map(_small, x.value.split("."))))
    if x.kind == "phone":
        return int(9 <= len(x.digits) <= 15) if len(x.digits) != 7 else None
    if x.kind == "email":
        return int(re.sub(r"\W+$", "", x.value).rsplit(".", 1)[-1].rsplit(" ", 1)[-1].strip(")]").isalpha())
    often = np.unique(list(x.value), return_counts=True)[1] / len(x.value)
    return int(-(often * np.log2(often)).sum() >= 3)


def written_form(x: Sight) -> int | None:
    if x.kind == "card":
        return int(re.fullmatch("[0-9]{13,16}|[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}", x.value) is not None)
    if x.kind == "ip":
        return int(not any(len(p) > 1 and p[0] == "0" for p in x.value.split("."))) if "." in x.value else None
    if x.kind == "phone":
        return int(re.search("[0-9]{3}[ .-]?[0-9]{4}$|([ .-][0-9]{2}){3,}$", x.value) is not None)
    if x.kind == "email":
        return int(re.match("[A-Za-z0-9._%+-]", x.value) is not None and len(x.value) <= 254)
    return int(len(x.value) >= 16 and any(c.isdigit() for c in x.value))


def gazetteer(x: Sight) -> int | None:
    if x.kind == "card":
        return int(ISSUERS.match(x.digits) is not None)
    if x.kind == "ip":
        return int(RESERVED.match(x.value) is None) if "." in x.value else None
    if x.kind == "phone":
        return int(any(x.digits[:n] in CALLING_CODES for n in (1, 2))) if x.value[0] == "+" else None
    if x.kind == "email":
        return 1 if x.value.rsplit(".", 1)[-1].lower() in DOMAINS else None
    return None


def credential_name(x: Sight) -> int | None:
    named = CREDENTIALS.search(x.before) is not None
    return int(named) if x.kind == "secret" else 0 if named else None


def cue_words(x: Sight) -> int | None:
    if CUES[x.kind].search(x.before):
        return 1
    return 0 if OTHER_CUES.search(x.before) else None


def surroundings(x: Sight) -> int | None:
    """Glued to letters, digits or the signs of numbers and paths, or not."""
    glued = [c.isalnum() or c in "_/\\#" for c in (x.left, x.right) if c]
    return int(not any(glued))


LABELERS = (base_rule, value_check, written_form, gazetteer, credential_name, cue_words, surroundings)


def votes(x: Sight) -> str:
    return "".join("-" if v is None else str(v) for v in (labeler(x) for labeler in LABELERS))


# --- estimation ----------------------------------------------------------------------------------

#: Votes that a labeler is credited with beforehand, and how many of them were right.
PRIOR, RIGHT = 5.0, 4.0


@dataclass
class Reliability:
    """What expectation-maximisation finds for a kind: the share of true candidates, and per labeler how often its
    votes on true candidates are for (``sensitivity``) and on false ones against (``specificity``)."""

    share: float
    sensitivity: np.ndarray
    specificity: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a candidate is true, for each row of votes (1, 0, or -1 for none)."""
        true = np.where(v == 1, np.log(self.sensitivity), np.where(v == 0, np.log1p(-self.sensitivity), 0)).sum(axis=1)
        false = np.where(v == 0, np.log(self.specificity), np.where(v == 1, np.log1p(-self.specificity), 0)).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(false - true + np.log1p(-self.share) - np.log(self.share), -500, 500)))


def vote_matrix(patterns: list[str]) -> np.ndarray:
    return np.array([["01".find(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), len(LABELERS))


def estimate(patterns: list[str], counts: list[int], rounds: int = 100) -> Reliability:
    """Reliabilities from the counts of all patterns of votes of a kind, starting from the majority."""
    v, n = vote_matrix(patterns), np.array(counts, float)
    q = ((v == 1).sum(axis=1) + 1) / ((v >= 0).sum(axis=1) + 2)
    for _ in range(rounds):
        t, f = (n * q)[:, None], (n * (1 - q))[:, None]
        found = Reliability(
            float(((n * q).sum() + 1) / (n.sum() + 2)),
            ((t * (v == 1)).sum(axis=0) + RIGHT) / ((t * (v >= 0)).sum(axis=0) + PRIOR),
            ((f * (v == 0)).sum(axis=0) + RIGHT) / ((f * (v >= 0)).sum(axis=0) + PRIOR),
        )
        new = found.posterior(v)
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return found


# --- classifier ----------------------------------------------------------------------------------


def features(x: Sight) -> list[int]:
    """Hashed features of form and context; every candidate has the same number of them."""
    form = re.sub("9+", "9", re.sub("a+", "a", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", x.value[:80]))))
    word = re.findall(r"\w+", x.before)
    names = (
        "",
        f"form {form[:24]}",
        f"digits {min(len(x.digits), 40)}",
        f"size {min(len(x.value), 1 << 12).bit_length()}",
        f"left {_class(x.left)}",
        f"right {_class(x.right)}",
        f"word {word[-1] if word else ''}",
        f"sum {luhn(x.digits) if 1 < len(x.digits) < 40 else None}",
        f"start {x.value[:1] if not x.value[:1].isalpha() else 'a'}",
    )
    return [zlib.crc32(f"{x.kind} {name}".encode()) % WEIGHTS for name in names]


def _class(c: str) -> str:
    return "end" if not c else "a" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else c


def train(rows: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model for soft targets, by gradient descent with momentum."""
    weights, speed = np.zeros(WEIGHTS), np.zeros(WEIGHTS)
    if not len(rows):
        return weights
    often = np.bincount(rows.ravel(), minlength=WEIGHTS)
    for _ in range(rounds):
        miss = target - score(weights, rows)
        slope = np.bincount(rows.ravel(), np.repeat(miss, rows.shape[1]), WEIGHTS) / np.sqrt(often * len(rows) + 1)
        speed = 0.9 * speed + rate * (slope - decay * weights)
        weights = weights + speed
    return weights


def score(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[rows].sum(axis=1), -500, 500)))


# --- Spark ---------------------------------------------------------------------------------------

_SEEN = pa.schema([("kind", pa.string()), ("votes", pa.string()), ("features", pa.list_(pa.int32())), ("pick", pa.int64())])


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """The rows whose text can hold a candidate."""
    texts = batch.column("text")
    for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _WORTH_READING), False).to_numpy(zero_copy_only=False)).tolist():
        yield i, texts[i].as_py()


def _see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {name: [] for name in _SEEN.names}
        for _, text in _read(batch):
            for candidate in candidates(text):
                x = sight(text, candidate)
                out["kind"].append(x.kind)
                out["votes"].append(votes(x))
                out["features"].append(features(x))
                out["pick"].append(zlib.crc32(f"{x.kind} {x.before} {x.value}".encode()))
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _SEEN], schema=_SEEN)


def decided(text: str, weights: np.ndarray) -> list[dict]:
    """The spans of a text: base ones, and the others that the classifier accepts, the best first."""
    found = candidates(text)
    if not found:
        return []
    scores = score(weights, np.array([features(sight(text, c)) for c in found])).tolist()
    kept = [(*c, p) for c, p in zip(found, scores) if c[3]]
    taken = Taken([])
    for c, p in sorted(zip(found, scores), key=lambda x: (-x[1], x[0][1], -x[0][2])):
        if not c[3] and p >= ACCEPTED and taken.free(c[1], c[2]):
            taken.take(c[1], c[2])
            kept.append((*c, p))
    kept.sort(key=lambda x: (KINDS.index(x[0]), x[1:]))
    return [dict(zip(("kind", "start", "end", "base", "score"), x)) for x in kept]


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"
_SPAN = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])
)


def _decide(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list[dict]] = [[] for _ in range(len(batch))]
            for i, text in _read(batch):
                spans[i] = decided(text, weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPAN)], ["doc_id", "spans"])

    return run


class PrivateData:
    """Labelers' reliabilities and a span classifier, learned from all candidates of a table of documents."""

    def __init__(self, docs: DataFrame, sample: int = SAMPLE):
        workspace = Workspace(prepared(docs.sparkSession, 2048))
        self.docs = docs.select("doc_id", F.col("text").cast("string"))
        seen = self.docs.mapInArrow(_see, "kind string, votes string, features array<int>, pick long")
        seen = workspace.stage(seen, "candidates")
        counts = seen.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
        self.reliabilities = {}
        for kind in sorted({row["kind"] for row in counts}):
            own = [row for row in counts if row["kind"] == kind]
            self.reliabilities[kind] = estimate([row["votes"] for row in own], [row["n"] for row in own])
        drawn = seen.orderBy("pick", "kind", "votes", "features").limit(sample).collect()
        target = np.zeros(len(drawn))
        for kind, found in self.reliabilities.items():
            own = np.array([i for i, row in enumerate(drawn) if row["kind"] == kind], np.int64)
            target[own] = found.posterior(vote_matrix([drawn[i]["votes"] for i in own]))
        self.weights = train(np.array([row["features"] for row in drawn], np.int64), target)

    def spans(self) -> DataFrame:
        """(doc_id, spans) of every document, by kind as listed and start."""
        return self.docs.mapInArrow(_decide(self.weights), f"doc_id {self.docs.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


def _counted(kind: str):
    return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")


def _listed(spans) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def op11_private_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return PrivateData(docs).spans().select(
        "doc_id",
        *map(_counted, ("email", "ip", "card", "phone")),
        F.sha2(_listed(F.filter("spans", lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
