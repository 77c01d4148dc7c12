"""Secret scan: candidates by pattern, false positives removed by a random forest.

Patterns propose candidates; the forest, trained on labelled findings, judges each one by its
length and kind, its character transitions, how much of it dictionary words cover, its path and
the words beside it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, map_batches

#: What proposes candidates; the group ``value`` is the candidate, of any length. Fixed formats of well-known credentials first.
PATTERNS = {
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:\s*+[A-Za-z-]++:[^\n]*+\n)*+(?P<value>[A-Za-z0-9+/=\s]{16,}?)(?:-----END|\Z)",
    "cloud_key": r"\b(?P<value>(?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "host_token": r"\b(?P<value>gh[pousr]_[A-Za-z0-9]{36,}+)\b",
    "chat_token": r"\b(?P<value>xox[abprs]-[A-Za-z0-9-]{10,})\b",
    "web_token": r"\b(?P<value>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "url_password": r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:(?P<value>[^\s/:@]{4,}+)@",
    "assignment": r"(?i:(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|credentials?|private[_-]?key)\b[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3})[\"']?(?P<value>[^\s\"'<>;,]{6,}+)",
    "hex": r"\b(?P<value>[0-9a-f]{32,}+|[0-9A-F]{32,}+)\b",
    "opaque": r"(?<![A-Za-z0-9+/_=-])(?P<value>[A-Za-z0-9+/_-]{20,}+={0,2}+)(?![A-Za-z0-9+/_=-])",
}
COMPILED = {kind: re.compile(p) for kind, p in PATTERNS.items()}
KINDS = list(PATTERNS)
#: An opaque string is a candidate with letters, digits and so many bits a character.
OPAQUE_BITS = 3.0
#: Words and code points beside a candidate that its features see.
NEAR_WORDS, NEAR_CHARS = 4, 80
#: Buckets of the hashed neighbouring words.
NEAR_BUCKETS = 16
CREDENTIAL_WORDS = frozenset("access api apikey auth authorization aws bearer credential credentials key login pass passwd password private pwd secret token".split())
HARMLESS_WORDS = frozenset("checksum commit digest etag example guid hash id md5 placeholder revision rev sample sha sha1 sha256 test uuid version".split())
PATH_WORDS = frozenset("demo doc docs example examples fixture fixtures mock sample samples spec test tests".split())
TREES, DEPTH, SEED = 30, 8, 29
#: Least occurrences of a dictionary word, most dictionary words, and their letters (what coverage looks up).
DICTIONARY_LEAST, DICTIONARY_WORDS, DICTIONARY_LENGTHS = 3, 1 << 19, (3, 14)
THRESHOLD = 0.5

WORD = re.compile(r"[A-Za-z]+(?:_[A-Za-z]+)*")


def bits(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find_candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) without overlaps: earlier kinds of the list win."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in COMPILED.items():
        for m in pattern.finditer(text):
            a, b = m.span("value")
            value = m["value"]
            if kind == "opaque" and (value.isalpha() or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value) or bits(value) < OPAQUE_BITS):
                continue
            found.append((a, b, kind))
    if len(found) > 1:
        order = {kind: k for k, kind in enumerate(KINDS)}
        found.sort(key=lambda x: (order[x[2]], x[0]))
        taken: list[tuple[int, int, str]] = []
        edges: list[tuple[int, int]] = []
        from bisect import bisect_left, insort

        for a, b, kind in found:
            at = bisect_left(edges, (a, b))
            if (at == 0 or edges[at - 1][1] <= a) and (at == len(edges) or edges[at][0] >= b):
                insort(edges, (a, b))
                taken.append((a, b, kind))
        found = sorted(taken)
    return found


def beside(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - NEAR_CHARS) : start], text[end : end + NEAR_CHARS]


class Language:
    """Letter transitions (27 x 27 counts, 0 is no letter) and the dictionary of ordinary text."""

    def __init__(self, transitions: np.ndarray, words: frozenset[str]):
        counts = transitions + 1.0
        self.surprise = -np.log2(counts / counts.sum(1, keepdims=True))
        self.words = words

    def transition_bits(self, value: str) -> float:
        """Mean surprise of the value's letter transitions."""
        code = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in value.lower()]
        return float(np.mean([self.surprise[a, b] for a, b in zip(code, code[1:])])) if len(code) > 1 else 0.0

    def coverage(self, value: str) -> float:
        """Share of the value's characters that dictionary words cover, longest word first from the left."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            for size in range(min(14, len(low) - at), 2, -1):
                if low[at : at + size] in self.words:
                    covered += size
                    at += size
                    break
            else:
                at += 1
        return covered / len(low) if low else 0.0


def features(language: Language, value: str, kind: str, before: str, after: str, path: str) -> list[float]:
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "p" for c in value]
    n = max(1, len(value))
    changes = Counter(a + b for a, b in zip(classes, classes[1:]))
    share = Counter(classes)
    left = [w.lower() for w in WORD.findall(before)][-NEAR_WORDS:]
    right = [w.lower() for w in WORD.findall(after)][:NEAR_WORDS]
    parts = {p for w in left + right for p in w.split("_")}
    near = [0.0] * NEAR_BUCKETS
    for w in left[-2:]:
        near[sum(map(ord, w)) % NEAR_BUCKETS] = 1.0
    folders = [p.lower() for p in re.split(r"[\W_]+", path) if p]
    return [
        float(len(value)),
        bits(value),
        language.transition_bits(value),
        language.coverage(value),
        *(share[c] / n for c in "dulp"),
        *(sum(changes[a + b] for a, b in pairs) / n for pairs in (("ld", "dl", "ud", "du"), ("lu", "ul"), ("lp", "pl", "up", "pu", "dp", "pd"))),
        len(set(value)) / n,
        float(max((len(m[0]) for m in re.finditer(r"(.)\1*", value)), default=0)) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}", value))),
        float(bool(CREDENTIAL_WORDS & parts)),
        float(bool(HARMLESS_WORDS & parts)),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(bool(re.search(r"[\\/.]$", before))),
        float(bool(PATH_WORDS & set(folders))),
        float(len(folders)),
        float(KINDS.index(kind)) if kind in PATTERNS else -1.0,
        *near,
    ]


def example_findings(spark: SparkSession, count: int = 3_000, seed: int = 1) -> DataFrame:
    """Labelled findings by rule: value, kind, before, after, path, label.

    Secrets are drawn at random in the contexts credentials have; the others are what scans report
    in vain: identifiers, checksums and commits, placeholders, words, file names.
    """
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    draw = lambda alphabet, n: "".join(alphabet[k] for k in rng.integers(len(alphabet), size=n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexes, mixed = digits + "abcdef", lower + lower.upper() + digits
    syllables = "ban con der en for ing la me nor or per re sta ter ver".split()
    prose = lambda n: " ".join("".join(pick(*syllables) for _ in range(rng.integers(1, 4))) for _ in range(n))
    rows = []
    for k in range(count):
        word = pick("token", "secret", "password", "api_key", "access_key", "auth_key", "credential", "private_key")
        lead = pick("", "db_", "service_", "my_", "aws_")
        link = pick(" = ", "=", ": ", " := ")
        mark = pick('"', "'", "")
        path = pick("src/app/settings.py", "config/prod.env", "deploy/run.sh", "web", "notes")
        before, after = f"{prose(4)} {lead}{word}{link}{mark}", f"{mark} {prose(4)}"
        special = pick("private_key", "chat_token", "url_password", "hex", "opaque") if rng.random() < 0.3 else None
        if special:
            label = 1 - k % 2
            if special == "private_key":
                value = draw(mixed + "+/", rng.integers(200, 1600)) if label else pick("your key goes here ", "paste the key here ", "base64 of the key ", "example example example ")
                before, after = f"{prose(2)} -----BEGIN {pick('RSA ', 'EC ', '')}PRIVATE KEY-----", "-----END"
            elif special == "chat_token":
                kind = f"xox{pick('a', 'b', 'p', 'r', 's')}-"
                value = kind + (f"{draw(digits, 12)}-{draw(digits, 12)}-{draw(mixed, 24)}" if label else pick("your-token-here", "xxxxxxxxxxxx-xxxxxxxxxxxx", "placeholder", "example-token"))
                before, after = pick(before, prose(4) + " "), f" {prose(4)}"
            elif special == "url_password":
                value = draw(mixed + "!#%&*+-_", rng.integers(10, 40)) if label else pick("password", "changeme", "pass", "xxxxxx", "your_password", "example", prose(1) + "word")
                before, after = f"{prose(4)} {pick('https', 'postgres', 'amqp')}://{prose(1)}:", f"@{prose(1)}.example/db"
            elif special == "hex":
                value = draw(hexes, pick(32, 40, 64, 200))
                before = f"{prose(4)} {pick('Bearer', 'credential', 'auth key', 'secret key') if label else pick('commit', 'sha256', 'md5', 'checksum', 'etag')} "
                after = f" {prose(4)}"
            else:
                value = draw(mixed + "+/", rng.integers(40, 800)) if label else "/".join(prose(1) for _ in range(rng.integers(3, 30))) + f"/v{rng.integers(10)}"
                before, after = f"{prose(4)} {pick('Bearer', 'credential', 'auth key', 'secret key') if label else pick('file', 'path', prose(1))} ", f" {prose(4)}"
            rows.append((value, special, before, after, path, label))
        elif k % 2 == 0:
            value, kind = pick(
                (draw(hexes, pick(32, 40, 64)), "assignment"),
                (draw(mixed, rng.integers(16, 48)), "assignment"),
                (draw(mixed + "!#%&*+-_", rng.integers(10, 24)), "assignment"),
                ("AKIA" + draw(lower.upper() + digits, 16), "cloud_key"),
                ("ghp_" + draw(mixed, 36), "host_token"),
                (f"eyJ{draw(mixed, 20)}.eyJ{draw(mixed, 40)}.{draw(mixed + '-_', 43)}", "web_token"),
            )
            if kind != "assignment" and rng.random() < 0.5:
                before, after = prose(4) + " ", " " + prose(4)
            rows.append((value, kind, before, after, path, 1))
        else:
            plain = f"{prose(4)} {pick('commit', 'sha256', 'md5', 'checksum', 'etag', 'uuid', 'revision', 'id', 'file', prose(1))}{pick(' ', ': ', '=')}"
            value, kind, before = pick(
                (draw(hexes, pick(32, 40, 64)), "hex", plain),
                ("-".join(draw(hexes, n) for n in (8, 4, 4, 4, 12)), "opaque", plain),
                (pick("changeme", "your_token_here", "xxxxxxxxxxxx", "placeholder", "********", "example_key", "<password>", "password123", "None", "os.environ[TOKEN]", "${SECRET}"), "assignment", before),
                (prose(1) + prose(1) + str(rng.integers(100)), "assignment", before),
                ("/".join(prose(1) for _ in range(3)) + f"/v{rng.integers(10)}.html", "opaque", prose(4) + " "),
                ("".join(pick(*syllables).title() for _ in range(7)) + str(rng.integers(1000)), "opaque", prose(4) + " "),
            )
            rows.append((value, kind, before, f" {prose(4)}", pick(path, "tests/data/sample.txt", "docs/example.md"), 0))
    return spark.createDataFrame(rows, "value string, kind string, before string, after string, path string, label int")


def count_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n over all documents: words of DICTIONARY_LENGTHS letters, and transitions as the number 27 * from + to."""
    least, most = DICTIONARY_LENGTHS

    def make():
        code = np.zeros(256, np.int64)
        code[97:123] = np.arange(1, 27)

        def apply(batch):
            text = "\n".join(["", *batch.column("text").to_pylist(), ""]).lower()
            letters = code[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
            pairs = np.bincount(letters[:-1] * 27 + letters[1:], minlength=27 * 27)
            words = {w: n for w, n in Counter(re.findall(r"[a-z]+", text)).items() if least <= len(w) <= most}
            met = [k for k in range(1, 27 * 27) if pairs[k]]  # 0: no letter beside no letter
            return {"key": [*words, *map(str, met)], "n": [*words.values(), *(int(pairs[k]) for k in met)]}

        return apply

    return map_batches(documents(df, id_col, text_col), make, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def learn_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Language:
    """Transitions and dictionary of all documents. A dictionary word occurs DICTIONARY_LEAST times at least, and
    once in DICTIONARY_WORDS words; so there are DICTIONARY_WORDS at most, of 14 letters at most, on any input."""
    counts = materialize(count_language(df, id_col, text_col), "language")
    transitions = np.zeros(27 * 27)
    for key, n in counts.where(~F.col("key").rlike("[a-z]")).collect():
        transitions[int(key)] = n
    words = counts.where(F.col("key").rlike("[a-z]"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = max(DICTIONARY_LEAST, -(-total // DICTIONARY_WORDS))
    found = words.where(F.col("n") >= often).select("key").toArrow().column("key").to_pylist()
    return Language(transitions.reshape(27, 27), frozenset(found))


def fit_forest(findings: DataFrame, language: Language) -> RandomForestClassificationModel:
    """Train on labelled findings (value, kind, before, after, path, label); rows with a null value or label are left out."""

    def make():
        def apply(batch):
            columns = [[x or "" for x in batch.column(c).to_pylist()] for c in ("value", "kind", "before", "after", "path")]
            return {"features": [features(language, *row) for row in zip(*columns)], "label": batch.column("label")}

        return apply

    usable = findings.where("value is not null and label is not null").select("value", "kind", "before", "after", "path", F.col("label").cast("double").alias("label"))
    rows = map_batches(usable, make, "features array<double>, label double")
    forest = RandomForestClassifier(featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8)
    return forest.fit(rows.select(array_to_vector("features").alias("vector"), "label").coalesce(1))


def scan_secrets(df: DataFrame, forest: RandomForestClassificationModel, language: Language, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """doc_id, start, length (code points), kind, value, score, secret: one row a candidate of every whole text.

    Overlapping candidates are one, of the kind that comes first in PATTERNS; so equal spans are one finding. Null and empty texts
    have none; a null path is an empty one. Rows are judged one by one whatever their id: a null id stays null, and repeated rows repeat their findings.
    """

    def make():
        def apply(batch):
            rows = []
            for doc_id, text, path in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path"))):
                for a, b, kind in find_candidates(text):
                    rows.append((doc_id, a, b - a, kind, text[a:b], features(language, text[a:b], kind, *beside(text, a, b), path)))
            return dict(zip(("doc_id", "start", "length", "kind", "value", "features"), zip(*rows) if rows else ((),) * 6))

        return apply

    path = F.coalesce(F.col(path_col), F.lit("")) if path_col else F.lit("")
    docs = documents(df.withColumn("__path", path), id_col, text_col, "__path").withColumnRenamed("__path", "path")
    found = map_batches(docs, make, "doc_id long, start long, length long, kind string, value string, features array<double>")
    judged = forest.transform(found.withColumn("vector", array_to_vector("features")))
    score = vector_to_array("probability")[1]
    return judged.select("doc_id", "start", "length", "kind", "value", score.alias("score"), (score >= THRESHOLD).alias("secret"))


def digest_columns(found: DataFrame) -> DataFrame:
    """Findings without the secrets themselves."""
    return found.select("doc_id", "start", "length", "kind", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.round("score", 6).alias("score"), "secret")
