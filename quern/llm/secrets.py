"""Secret scan: candidates by pattern, a random forest against false positives.

A candidate is a run of 16 or more token characters with a digit among them, the
value (quoted or not) of an assignment to a telling name or of such a key in
JSON, what follows ``Bearer``, or the password in a URL. Of candidates that are
secrets and overlap, the first and longest is the finding. A token of three parts
with dots is one. The forest judges it by its length,
its character transitions (changes between classes, surprise of its letter
pairs), the part of it that dictionary words cover, whether it lies on a path or
address, and the words next to it.

Training: labelled findings (candidate, before, after, is_secret). A project has
its own, which ``labelled_findings`` reads from documents and marked places;
without them ``sample_findings`` makes a fixed, seeded set of known
shapes: keys, tokens and passwords in assignments against commit ids, checksums,
UUIDs, numbers, file names, placeholders and long words. At most ``MAX_FINDINGS``
findings train the forest, which is small and travels with the tasks.

Scale: a prefilter and the extraction run in the JVM; only documents with a
candidate reach Python, and of these only the candidates with a few words on
either side. Nothing is shuffled.

Nulls and edges: null and empty texts have no findings. Every occurrence is a
finding of its own, so a repeated secret or row gives a row each. Candidates of
any length are judged whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FINDINGS, TREES, DEPTH, THRESHOLD = 4000, 40, 10, 0.5
CONTEXT = 48
_RUN = r"[A-Za-z0-9+/_\-]"
_NAME = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_\- ]?key|auth(?:orization|entication)?|credential|bearer|private(?:[_\- ]?key)?|access[_\- ]?key|(?<![A-Za-z])key)"
#: Java and Python read these alike; a group holds the candidate where it isn't the whole match.
PATTERNS = [
    # a run with a digit; = is only padding at its end
    rf"(?<!{_RUN})(?=[A-Za-z+/_\-]*+\d){_RUN}{{16,}}+={{0,2}}",
    # a value after a telling name and a sign; the value isn't consumed, as it may hold a name and sign of its own
    rf"{_NAME}(?:[_\-]\w{{1,16}}|[A-Z]\w{{1,16}}|\d{{1,3}}|s)?[\"'`]?\s{{0,3}}(?::=|=>|[=:])\s{{0,3}}(?=\"([^\"\s]{{6,}})\"|'([^'\s]{{6,}})'|`([^`\s]{{6,}})`|([^\s\"'`<>,;&]{{5,}}[^\s\"'`<>,;&.:]))",
    r"(?i:bearer)\s{1,3}[\"'`]?([A-Za-z0-9+/_.~\-]{16,}={0,2})",
    r"[A-Za-z][A-Za-z0-9+.\-]{1,15}://[^\s:/@\"']*:([^\s@/\"']{2,})@(?=[\w\[])",
    rf"(?<!{_RUN})eyJ{_RUN}{{8,}}+\.eyJ{_RUN}{{8,}}+\.{_RUN}{{8,}}+",
]
_COMPILED = [re.compile(p) for p in PATTERNS]
_DICTIONARY = """about access account admin after again agent alpha apple application archive backup bench beta block branch build button cache
cancel change changeme channel checksum class client cloud code commit config connect content control copy count cover create customer data database date
debug default delete deploy design detail device digest docs document domain download dummy edit email enable error event example fake false field file filter
final fingerprint folder font form format frame function group guide hash header hello help home host icon image index info input insert install
invalid issue item json keyboard label language layout level library line link list local locale login main manager master media menu message method mode model
module monitor name network node none note null number object option order output page panel param part password path pattern picture pixel place
placeholder player plugin point policy port post preview primary print private process product profile project public query random readme record
redacted reference release report request reset resource response result revision root route sample save schema screen script search second secret section
select server service session setting shape share signature simple site size source spec stage standard start state static status step storage string style
submit summary support switch system table target task template test text theme thumb time title token tool track transaction tree true type undefined unit unknown
update upload user utils value version video view warning watch widget window word world worker xxxx your""".split()
_WORDS = sorted({w for w in _DICTIONARY if len(w) >= 4}, key=len, reverse=True)
_WORD_RE = re.compile("|".join(_WORDS))
_TELLING = re.compile(r"(?i)pass(?:word|wd|phrase)?|secret|token|api[_\- ]?key|auth|credential|bearer|private|access[_\- ]?key|\bkey\b|pwd")
_HARMLESS = re.compile(r"(?i)commit|sha-?\d*|md5|checksum|digest|revision|etag|uuid|guid|hash|version|example|sample|test|build|isbn|card|order|phone|call|invoice|account|tracking|image|file|src|href|path|fingerprint|integrity")
_ASSIGN = re.compile(r"[=:]\s*[\"'`]?$")
_IN_URL = re.compile(r"://[^\s/@]*:$")
_CLASS = {**dict.fromkeys(string.ascii_lowercase, 0), **dict.fromkeys(string.ascii_uppercase, 1), **dict.fromkeys(string.digits, 2)}
#: Letter pairs that are frequent in words of several languages
_PAIRS = set("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ei ie ge sc un ne nt la ue os do ad ci qu ai eu au oi".split())
FEATURES = 17


def features(candidate: str, before: str, after: str) -> list[float]:
    n = len(candidate)
    classes = [_CLASS.get(c, 3) for c in candidate]
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    letters = [c for c in candidate.lower() if c.isascii() and c.isalpha()]
    pairs = [a + b for a, b in zip(candidate.lower(), candidate.lower()[1:]) if a.isalpha() and b.isalpha()]
    counts = [candidate.count(c) for c in set(candidate)]
    entropy = -sum(k / n * math.log2(k / n) for k in counts) if n else 0.0
    covered = sum(len(m) for m in _WORD_RE.findall(candidate.lower()))
    near, words = before[-24:], f"{before} {after}"
    return [
        n,
        changes / max(n - 1, 1),
        entropy,
        entropy / max(math.log2(n), 1.0) if n > 1 else 0.0,
        sum(c == 2 for c in classes) / max(n, 1),
        sum(c == 1 for c in classes) / max(n, 1),
        sum(c == 3 for c in classes) / max(n, 1),
        sum(p in _PAIRS for p in pairs) / max(len(pairs), 1),
        covered / max(n, 1),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", candidate))),
        float(bool(re.search(r"[/\\.]\S*$", before) or candidate.count("/") > 1 or re.match(r"[/.]\w", after))),  # on a path or address
        float(bool(_TELLING.search(near))),
        float(bool(_ASSIGN.search(before))),
        float(bool(_HARMLESS.search(words))),
        len(letters) / max(n, 1),
        float(bool(_IN_URL.search(before) and after.startswith("@"))),
    ]


class Forest:
    """Random forest of binary trees on a bounded training set; trees are flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], depth, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, value = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            at = len(feature)
            p = float(y[rows].mean())
            for a, v in ((feature, -1), (cut, 0.0), (left, at), (right, at), (value, p)):
                a.append(v)
            if level == depth or len(rows) < 4 or p in (0.0, 1.0):
                return at
            best = (0.0, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, math.isqrt(x.shape[1])), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows[order], f], np.cumsum(y[rows[order]])
                k = np.flatnonzero(v[:-1] < v[1:])
                if len(k):
                    n, total = len(rows), t[-1]
                    nl, sl = k + 1, t[k]
                    nr, sr = n - nl, total - t[k]
                    gain = sl * sl / nl + sr * sr / nr - total * total / n
                    b = int(gain.argmax())
                    if gain[b] > best[0] + 1e-12:
                        best = (float(gain[b]), int(f), float((v[k[b]] + v[k[b] + 1]) / 2))
            if best[1] < 0:
                return at
            low = x[rows, best[1]] <= best[2]
            feature[at], cut[at] = best[1], best[2]
            left[at], right[at] = node(rows[low], level + 1), node(rows[~low], level + 1)
            return at

        node(np.arange(len(x)), 0)
        return tuple(map(np.array, (feature, cut, left, right, value)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at]))
            out += value[at]
        return out / len(self.trees)


def sample_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, str, str, bool]]:
    """Labelled findings (candidate, before, after, is_secret) of known shapes."""
    r = random.Random(seed)
    hexed = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    mixed = lambda k, more="": "".join(r.choices(string.ascii_letters + string.digits + more, k=k))
    syllable = ["an", "ber", "cion", "de", "en", "er", "ge", "in", "ka", "la", "mo", "ne", "on", "re", "st", "ta", "th", "tion", "ung", "ve"]
    word = lambda: "".join(r.choices(syllable, k=r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 7)))
    names = ["token", "secret", "api_key", "apiKey", "password", "auth_token", "access_key", "client_secret", "private_key", "bearer", "pwd", "passphrase", "dbPassword", "credential"]
    dictionary = lambda: r.choice(_DICTIONARY)

    def secret() -> tuple[str, str, str]:
        value = r.choice([lambda: hexed(r.choice([32, 40, 40, 48, 64])), lambda: mixed(r.randint(20, 44)), lambda: mixed(r.randint(24, 60), "+/") + "=" * r.randint(0, 2), lambda: r.choice(["sk_live_", "ghx_", "pat-", "xoxz-"]) + mixed(r.randint(20, 40)), lambda: mixed(r.randint(16, 24), "_-")])()
        lead = r.randrange(9)
        if lead == 8:
            value = r.choice([lambda: ".".join(["eyJ" + mixed(r.randint(16, 40)), "eyJ" + mixed(r.randint(24, 90), "-_"), mixed(r.randint(30, 60), "-_")]), lambda: r.choice(["ghp_", "AKIA", "glpat-", "xoxb-"]) + mixed(r.randint(16, 40))])()
            return value, f"{prose()} {r.choice(['', '', 'token ', 'here is ', 'key '])}", f" {prose()}"
        if lead > 5:  # passwords and keys of letters
            value = r.choice([lambda: word() + word() + str(r.randint(10, 9999)) + r.choice(["", "", "!", "#"]), lambda: word().title() + r.choice("!@#$%_") + str(r.randint(1, 999)) + word(), lambda: mixed(r.randint(8, 15)), lambda: "".join(r.choices(string.ascii_letters, k=r.randint(20, 44))), lambda: word() + str(r.randint(1, 99)) + r.choice([word(), dictionary()])])()
        if lead == 7 and r.random() < 0.4:
            scheme = r.choice(["postgres", "mysql", "https", "amqp", "redis", "mongodb+srv"])
            return value.replace("@", "!"), f"{prose()} {scheme}://{r.choice(['user', 'admin', 'root', word()])}:", f"@{r.choice(['host', 'localhost', 'db.' + word() + '.com'])}/{word()} {prose()}"
        name = r.choice([str, str, str.upper, str.title])(r.choice(names))
        if lead % 3 == 0:
            return value, f"{prose()} {{\"{name}\": \"", f"\"}} {prose()}"
        quote = r.choice(['"', "'", ""])
        if lead == 6 and r.random() < 0.4:  # words in quotes
            value, quote = word() + word() + word(), quote or '"'
        if lead == 4:
            return value, f"{prose()} Authorization: Bearer {quote}", f"{quote} {prose()}"
        return value, f"{prose()} {r.choice(['', '', 'export '])}{name}{r.choice([' = ', '=', '=', ': ', ':', ' := '])}{quote}", f"{quote} {prose()}"

    def other() -> tuple[str, str, str]:
        kind = r.randrange(11)
        if kind == 0:
            return hexed(r.choice([32, 40, 40, 64])), f"{prose()} {r.choice(['commit ', 'sha1: ', 'md5sum ', 'checksum = ', 'digest: sha256:', 'revision ', 'etag: '])}", f" {prose()}"
        if kind == 1:
            u = hexed(32)
            return f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", f"{prose()} {r.choice(['id: ', 'uuid = ', 'request ', ''])}", f" {prose()}"
        if kind == 2:
            return "".join(r.choices(string.digits, k=r.randint(16, 22))), f"{prose()} {r.choice(['', 'card ', 'order ', 'no. ', 'tracking '])}", f" {prose()}"
        if kind == 3:
            return "/".join(dictionary() for _ in range(r.randint(2, 5))) + str(r.randint(0, 99)), f"{prose()} {r.choice(['src/', './', 'https://www.', '/'])}", f".{r.choice(['png', 'py', 'html', 'js'])} {prose()}"
        if kind == 4:
            return f"{dictionary()}{r.choice(['_', '-', ''])}{dictionary()}{r.choice(['_', '-', ''])}{dictionary()}{r.randint(1, 2024)}", f"{prose()} {r.choice(['', 'name = ', 'class=', 'token: ', 'key = '])}", f" {prose()}"
        if kind == 5:
            v = r.choice(["your-api-key-goes-here-1", "xxxxxxxxxxxxxxxxxxxx1", "example_token_0123456789", "changeme_password_123", "0000000000000000000000", "test-token-1234567890", "placeholder-secret-00"])
            return v, f"{prose()} {r.choice(names)} = \"", f"\" {prose()}"
        if kind == 6:
            return "".join(word() for _ in range(r.randint(5, 9))) + str(r.randint(0, 9)), f"{prose()} ", f" {prose()}"
        if kind == 8:  # what a telling name is said to be
            quote = r.choice(['"', "", "", ""])
            v = r.choice([lambda: word() if quote else word() + word() + word(), lambda: "".join(r.sample(_DICTIONARY, 2)), lambda: f"{dictionary()}_{dictionary()}", lambda: r.choice(["Bearer", "required", "optional", "changeme", "password", "undefined", "placeholder", "your_password"])])()
            return v, f"{prose()} {r.choice(names)}{r.choice([': ', ' = ', ': ', '='])}{quote}", f"{quote} {prose()}"
        if kind == 9:  # code that reads one
            return r.choice([f"{word()}.{word()}{r.choice(['', '()', '[0]'])}", f"get_{word()}{word()}()", f"os.environ[{word().upper()}]", f"${{{word().upper()}_{word().upper()}}}", f"https://{word()}.{word()}.com/{word()}{word()}"]), f"{prose()} {r.choice(names)}{r.choice([' = ', ': ', '='])}", f" {prose()}"
        if kind == 10:
            return r.choice(["password", "pass", "pw", "secret", "changeme", "xxxx", "****", "$PASSWORD", "example"]), f"{prose()} {r.choice(['postgres', 'mysql', 'https'])}://{r.choice(['user', 'username', word()])}:", f"@{r.choice(['host', 'localhost', 'example.com'])}/ {prose()}"
        return hexed(r.choice([20, 24, 32])) + r.choice(["", "_thumb", "-large"]), f"{prose()} /images/{dictionary()}/", f".jpg {prose()}"

    return [(*(secret() if i % 2 else other()), bool(i % 2)) for i in range(n)]


def labelled_findings(docs: DataFrame, marks: DataFrame, most: int = MAX_FINDINGS) -> list[tuple[str, str, str, bool]]:
    """Findings for ``train`` from marked places (doc_id, start, is_secret) of documents: the candidates that start there, ``most`` at most."""

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text, places in zip(rows["text"], rows["places"]):
                said = {p["start"]: p["is_secret"] for p in places}
                out += [(text[a : a + len(v)], text[max(0, a - CONTEXT) : a], text[a + len(v) :][:CONTEXT], said[a]) for a, v in candidates(text) if a in said]
            yield pd.DataFrame(out, columns=["candidate", "before", "after", "is_secret"])

    places = marks.where("doc_id IS NOT NULL AND start IS NOT NULL AND is_secret IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.struct("start", "is_secret")).alias("places"))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(places, "doc_id").select("text", "places")
    found = rows.mapInPandas(marked, "candidate string, before string, after string, is_secret boolean")
    return [tuple(r) for r in found.orderBy(F.xxhash64("candidate", "before"), "candidate").limit(most).collect()]


def train(findings: list[tuple[str, str, str, bool]] | None = None) -> Forest:
    rows = (sample_findings() if findings is None else findings)[:MAX_FINDINGS]
    return Forest(np.array([features(*r[:3]) for r in rows]), np.array([float(r[3]) for r in rows]))


def candidates(text: str) -> list[tuple[int, str]]:
    """Start and text of each candidate, each span once; a value with an assignment of its own gives way to it."""
    spans = [{m.span(m.lastindex or 0) for m in p.finditer(text)} for p in _COMPILED]
    named = sorted(set().union(*spans[1:]))
    named = [x for x, after in zip(named, [*named[1:], None]) if not (after and x[0] < after[0] < x[1])]
    return [(a, text[a:b]) for a, b in sorted({*spans[0], *named}, key=lambda x: (x[0], -x[1]))]


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start (0-based character), secret, probability of every finding."""
    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found, x = [], []
            for row, (doc_id, text) in enumerate(zip(rows["doc_id"], rows["text"])):
                for start, value in candidates(text):
                    end = start + len(value)
                    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
                    found.append((row, doc_id, start, value))
                    x.append(features(value, before, after))
            if found:
                p = np.round(forest.probability(np.array(x)), 6)
                # a finding within or across the one before it is the same secret
                kept, row, end = [], -1, 0
                for k in np.flatnonzero(p >= threshold):
                    if found[k][0] != row or found[k][2] >= end:
                        kept.append(k)
                        row, end = found[k][0], found[k][2] + len(found[k][3])
                out = pd.DataFrame([found[k][1:] for k in kept], columns=["doc_id", "start", "secret"])
                out["probability"] = p[kept]
                yield out.astype({"doc_id": rows["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    likely = docs.select("doc_id", "text").where(reduce(or_, (F.col("text").rlike(p) for p in PATTERNS)))
    return likely.mapInPandas(judged, f"doc_id {kind}, start int, secret string, probability double")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train())


QUERIES = {"op8_secret_scan": op8_secret_scan}
SQL: dict[str, str] = {}
