"""Secret scans: candidate strings, then a random forest that removes false positives.

Candidates are
* runs of at least `MIN` characters of `[A-Za-z0-9_+/.\\-]` with a digit or mixed case, and up to two
  `=` after them.  So a string that nothing introduces is found from 16 characters on; shorter ones
  are too often plain identifiers to be told apart by their looks;
* any quoted or unbroken value after a secret name, whatever its length and characters;
* the password of an address `scheme://user:password@host`;
* blocks of private keys between their BEGIN and END lines, in one.

A value and a run inside it are two candidates.  The forest looks at their length, classes and
transitions of characters (also how likely letters follow each other in words), entropy, the share
that dictionary words cover, prefixes by which vendors mark their keys, marks of a path or address or of a
place to be filled in, the path of the file, and the words around them.  It is trained in numpy on
labelled findings; by default these are drawn from a seeded generator of both kinds.  Other labelled
findings (text, begin, end, label, and a path if there is one) can be given.

A document's findings are all candidates whose vote is at least `threshold`.  Offsets count
code points.  The secret itself is returned only as a digest.  Nulls and empty texts have no
findings; a candidate of any length is judged whole.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import in_parts, small_batches, text_bytes

MIN, THRESHOLD = 16, 0.5
CANDIDATE = re.compile(r"[A-Za-z0-9_+/.\-]{%d,}={0,2}" % MIN)
MIXED = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z][a-z].*[A-Z]")
NEAR_WORD = re.compile(r"[A-Za-z]+")
#: Fixed words: names that secrets are assigned to, names of harmless strings, dictionary.
SECRET_NAMES = frozenset("token secret password passwd passphrase pass pwd pw key apikey auth credential credentials creds bearer basic access private session".split())
PLAIN_NAMES = frozenset("commit sha md5 checksum hash digest version build order invoice card account phone id uuid isbn issue page file path url date see example".split())
DICTIONARY = tuple("example test demo sample user name file data index page http https www com org net html main home local usr bin src lib config version license apache public static image report release build order number the and for with from this that".split())
#: A secret name with what may stand between it and its value, then the value: quoted, or unbroken.
ASSIGNED = re.compile(r"(?<![A-Za-z])(?:%s)(?![A-Za-z])[0-9]*[\"']?(?:\s*(?::=|=>|==?|:)\s*|[ \t]+)(?:\"([^\"\n]+)\"|'([^'\n]+)'|(\S+))" % "|".join(sorted(SECRET_NAMES, key=len, reverse=True)), re.I)
PUNCTUATED = "=:\"'"
ADDRESS = re.compile(r"://[^\s/:@]*:([^\s/@]+)@")
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----")
#: Ends of a text in which a secret name is assigned.
ASSIGNING = re.compile(r"(?<![A-Za-z])(?:%s)(?![A-Za-z])[0-9]*[\"']?\s*(?::=|=>|==?|:)\s*[\"']?$" % "|".join(sorted(SECRET_NAMES, key=len, reverse=True)), re.I)
#: Fixed forms: prefixes of vendors' keys, tokens and key blocks.
VENDOR = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_\w{30,}$|github_pat_\w{30,}$|glpat-[\w-]{18,}$|xox[abprs]-[\w-]{18,}$|[sr]k_(?:live|test)_\w{16,}$|AIza[\w-]{30,}$|SG\.[\w-]{16,}\.[\w-]{16,}$|npm_\w{30,}$|pypi-[\w-]{30,}$|ya29\.[\w-]{20,}$|eyJ[\w-]+\.eyJ[\w-]+\.[\w-]*$|-----BEGIN ")
#: Values that stand for others.
STANDS_IN = re.compile(r"[<$%{\[(]|x+$|\*+$|\.+$|your\b|your[_-]|none$|null$|true$|false$|.*(?:example|changeme|change_me|placeholder|dummy|redacted|\(\)|environ|getenv)|[A-Za-z_.]+\(", re.I)


def _transitions() -> dict[str, float]:
    """Of pairs of letters minus the log of their probability in words, by a table of the fixed words."""
    words = [*DICTIONARY, *SECRET_NAMES, *PLAIN_NAMES]
    pairs, firsts = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1)), Counter(c for w in words for c in w[:-1])
    low = string.ascii_lowercase
    return {a + b: -math.log((pairs[a + b] + 0.2) / (firsts[a] + 0.2 * 26)) for a in low for b in low}


TRANSITIONS = _transitions()


def features(text: str, begin: int, end: int, path: str = "") -> list[float]:
    s = text[begin:end]
    n = len(s)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in s]
    moves = sum(a != b for a, b in zip(classes, classes[1:]))
    counts = Counter(s)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    low = s.lower()
    covered = bytearray(n)
    for w in DICTIONARY:
        at = low.find(w)
        while at >= 0:
            covered[at : at + len(w)] = b"\x01" * len(w)
            at = low.find(w, at + 1)
    steps = [TRANSITIONS[p] for p in map("".join, zip(low, low[1:])) if p in TRANSITIONS]
    before, after = text[max(0, begin - 40) : begin], text[end : end + 20]
    words = [w.lower() for w in NEAR_WORD.findall(before)[-3:]]
    tail = before.rstrip()
    vowels = sum(c in "aeiou" for c in low) / max(1, sum(c.isalpha() for c in s))
    share = {k: classes.count(k) / n for k in "duls"}
    longest = max(map(len, NEAR_WORD.findall(s)), default=0)
    place = path.lower()
    return [
        n, share["d"], share["u"], share["l"], share["s"], moves / n, entropy, len(counts) / n, sum(covered) / n, vowels,
        float(all(c in string.hexdigits for c in s)), float(s.isdigit()), s.count("/"), s.count("."), s.count("-"), s.count("_"),
        float(bool(words) and words[-1] in SECRET_NAMES), float(any(w in SECRET_NAMES for w in words)), float(any(w in PLAIN_NAMES for w in words)),
        float(tail[-1:] in PUNCTUATED and bool(tail)), float(before[-1:] in "\"'" and bool(before)), float(after[:1] in "\"'" and bool(after)), float("://" in before[-12:] or "@" in before[-2:]),
        float(bool(VENDOR.match(s))), sum(steps) / len(steps) if steps else 0.0, longest / n, float(bool(ASSIGNING.search(before))), float(bool(STANDS_IN.match(s))),
        float(before[-1:] in tuple("/.\\@,;(")), float(after[:1] in tuple("/.@(")), float(bool(re.search(r"://[^\s/:@]*:$", before)) and after[:1] == "@"),
        float(any(x in place for x in ("test", "example", "sample", "doc", "readme"))), float(place.endswith((".lock", ".sum", ".svg", ".map", ".po"))), float(any(x in place for x in (".env", "config", "secret", "credential", ".pem"))),
    ]


def labelled_findings(n: int = 6000, seed: int = 11) -> list[tuple]:
    """(text, begin, end, label, path): generated findings, as many of either kind."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    caps, safe = string.ascii_uppercase + string.digits, alnum + "_-"
    word = lambda: pick("aeioulnrst", r.randint(2, 9))
    title = lambda: word().title()
    common = ["the", "to", "of", "is", "required", "and", "value", "none", "in", "was", "string", "true", "will", "must", "for"]
    name = lambda: r.choice(["token", "api_key", "secret", "password", "auth_token", "access key", "private key", "TOKEN", "apikey", "session token", "DB_PASS", "client_secret", "pwd"])
    joins = [" = \"", "=\"", ": ", "=", " = '", ": \"", " "]
    harmless = [
        lambda: ("", pick(string.digits, r.randint(16, 24))),
        lambda: (r.choice(["order ", "card ", "account ", "invoice no. "]), pick(string.digits, 16)),
        lambda: (r.choice(["commit ", "sha1 ", "md5: ", "checksum = ", "build ", "", "digest: ", "hash=", "see "]), pick(hexa, r.choice([32, 40, 64]))),
        lambda: (r.choice(["", "in ", "file ", "path = "]), "/".join(word() for _ in range(r.randint(3, 6))) + "/" + r.choice([pick(string.digits, 3) + ".html", title() + title() + ".java", word() + "_" + pick(string.digits, 2) + ".py"])),
        lambda: (r.choice(["https://", "see ", "path = ", "http://", "url: "]), "www." + word() + "." + word() + ".com/" + word() + pick(string.digits, 4)),
        lambda: (r.choice(["", "id ", "uuid: ", "id=", "request "]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: ("", title() + title() + title() + pick(string.digits, r.randint(0, 2))),
        lambda: (r.choice(["", "call ", "class "]), word() + title() + title() + title()),
        lambda: ("", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}" + r.choice([f"-{r.randint(1000, 9999)}-{word()}", f"T{r.randint(10, 23)}", f"_{word()}_{word()}.log"])),
        lambda: ("", word() + "_" + word() + "_" + word() + "_" + pick(string.digits, 2)),
        lambda: (r.choice(["version ", "release ", ""]), r.choice([".".join(pick(string.digits, 3) for _ in range(5)), f"{word()}-{word()}-1.{r.randint(0, 99)}.{r.randint(0, 9)}-{r.choice(['beta', 'SNAPSHOT', 'linux-x86_64'])}"])),
        lambda: ("", word() + "-" + word() + "-" + word() + "-" + word() + str(r.randint(1, 99))),
        lambda: (r.choice(["mail ", "to ", ""]), word() + "." + word() + pick(string.digits, 2) + "." + word() + ".example.com"),
        lambda: (r.choice(["token = \"", "key = '", "password: "]), r.choice(["example", "test", "sample"]) + "_" + word() + "_" + r.choice(["data", "value1", "name2", "user01"])),
        lambda: (r.choice(["integrity=\"", "checksum "]), r.choice(["sha256-", "sha512-"]) + pick(alnum + "+/", 43) + "="),
        lambda: ("data:image/png;base64,", pick(alnum + "+/", r.randint(40, 200))),
        lambda: (r.choice(["ssh-rsa ", "public key "]), "AAAA" + pick(alnum + "+/", r.randint(40, 120))),
    ]
    harmless += [  # values of secret names that are none
        lambda: (r.choice(["key ", "access ", "the secret ", "private ", "session ", "password ", "token ", "pass ", "basic "]), r.choice([word(), r.choice(common)])),
        lambda: (r.choice(["key: ", "session: ", "access: ", "token ", "pass: "]), r.choice([word(), r.choice(common), str(r.randint(1, 99))])),
        lambda: (r.choice(["key ", "session ", "pass "]), str(r.randint(1, 999))),
        lambda: (name() + r.choice(joins), r.choice(["<your " + word() + ">", "${" + word().upper() + "}", "$" + word().upper() + "_KEY", "x" * r.randint(4, 20), "*" * r.randint(4, 12), "changeme", "your_" + word() + "_here", "your-" + word(), "None", "null", "true", "", "%s", "{{ " + word() + " }}", "REDACTED", "EXAMPLE" + pick(caps, 4)]) or "none"),
        lambda: (name() + r.choice([" = ", "=", ": "]), r.choice([f"get_{word()}()", f"os.environ[\"{word().upper()}\"]", f"{word()}.{word()}.{word()}", f"self.{word()}_{word()}", f"{word()}(\"{word()}\")", f"config.{word()}", f"os.getenv('{word()}')"])),
    ]
    bodies = [lambda: pick(hexa, r.choice([32, 40, 40, 64])), lambda: pick(hexa.upper(), 40), lambda: pick(alnum, r.randint(20, 48)), lambda: pick(alnum + "+/", r.randint(24, 60)) + "==", lambda: pick(caps, 20), lambda: word()[:3] + "_" + pick(alnum, 36)]
    short = [
        lambda: pick(alnum, r.randint(6, 15)), lambda: pick(alnum + "!$%&*#@^", r.randint(8, 20)), lambda: pick(string.ascii_lowercase, r.randint(8, 24)), lambda: title() + pick(string.digits, 4) + pick("!$#", 1),
        lambda: word() + pick(string.digits, r.randint(1, 4)) + word(), lambda: "-".join([word(), word(), word(), pick(string.digits, 2)]), lambda: title() + r.choice("!@#_.-") + pick(string.digits, 3) + r.choice(["", word()]) + r.choice(["", "!", "?"]),
        lambda: word().replace("a", "4").replace("e", "3").replace("o", "0") + pick("!$&", 1) + pick(alnum, 4),
    ]
    alone = [
        lambda: r.choice(["AKIA", "ASIA"]) + pick(caps, 16), lambda: r.choice(["ghp_", "gho_", "ghs_"]) + pick(alnum, 36), lambda: "github_pat_" + pick(alnum, 22) + "_" + pick(alnum, 40), lambda: "glpat-" + pick(safe, 20),
        lambda: r.choice(["xoxb-", "xoxp-"]) + pick(string.digits, 11) + "-" + pick(string.digits, 11) + "-" + pick(alnum, 24), lambda: r.choice(["sk_live_", "rk_live_", "sk_test_"]) + pick(alnum, 24), lambda: "AIza" + pick(safe, 35),
        lambda: "SG." + pick(safe, 22) + "." + pick(safe, 43), lambda: "npm_" + pick(alnum, 36), lambda: "eyJ" + pick(safe, r.randint(15, 40)) + ".eyJ" + pick(safe, r.randint(20, 120)) + "." + pick(safe, 43),
        lambda: pick(alnum + "+/", r.randint(32, 64)) + r.choice(["", "=", "=="]), lambda: pick(alnum, r.randint(32, 48)),
    ]

    def block():
        kind = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"])
        return f"-----BEGIN {kind}-----\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(r.randint(2, 20))) + f"\n-----END {kind}-----"

    secret = [
        lambda: (name() + r.choice(joins), r.choice(bodies)()),
        lambda: (name() + r.choice(joins), r.choice(bodies)()),
        lambda: (r.choice(["password", "passwd", "pwd", "db_password", "secret", "DB_PASS", "pass", "passphrase"]) + r.choice(joins[:6]), r.choice(short)()),
        lambda: (r.choice(["password", "passwd", "pwd", "db_password", "secret", "DB_PASS", "pass", "passphrase"]) + r.choice(joins[:6]), r.choice(short)()),
        lambda: (r.choice(["", "", "use ", "is ", "(", "- ", "\"", "key ", "here: ", "export X="]), r.choice(alone)()),
        lambda: (r.choice(["", "", "use ", "is ", "(", "- ", "\"", "key ", "here: ", "export X="]), r.choice(alone)()),
        lambda: (r.choice(["Authorization: Bearer ", "bearer ", "Authorization: Basic ", "-H 'Authorization: token "]), r.choice([pick(safe, r.randint(20, 60)), pick(alnum, 24) + "=="])),
        lambda: (r.choice(["postgres", "https", "mysql", "mongodb", "redis", "amqp"]) + "://" + word() + ":", r.choice([*short[:2], *short[3:], bodies[2]])()),
        lambda: (r.choice(["", "\n", "key:\n"]), block()),
    ]
    out = []
    for i in range(n):
        left = " ".join(word() for _ in range(r.randint(0, 6))) + " "
        right = r.choice(["", "\"", " ", "' ", "\" ", "; ", ", ", "\n", ")"]) + " ".join(word() for _ in range(r.randint(0, 5)))
        head, body = r.choice(secret if i % 2 else harmless)()
        if "://" in head and i % 2:
            right = "@" + word() + "." + word() + ":5432/" + word() + right
        path = r.choice(["", "", "", "", word() + ".py", "src/" + word() + ".java", r.choice(["tests/", "docs/", "examples/"] if not i % 2 else ["src/", "app/"]) + word() + ".md", (".env" if i % 2 else "yarn.lock")])
        begin = len(left) + len(head)
        out.append((left + head + body + right, begin, begin + len(body), i % 2, path))
    return out


class Forest:
    """A random forest of binary trees, grown on bootstrap samples by Gini impurity."""

    def __init__(self, trees: int = 25, depth: int = 12, seed: int = 5):
        self.trees, self.depth, self.seed = trees, depth, seed
        self.grown: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[tuple] = []
            self._grow(x[rows], y[rows], 0, nodes, rng)
            self.grown.append(nodes)
        return self

    def _grow(self, x, y, depth, nodes, rng) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        if depth == self.depth or len(y) < 4 or y.min() == y.max():
            return at
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                left, total = cut + 1.0, len(y)
                p, q = ones[cut] / left, (ones[-1] - ones[cut]) / (total - left)
                impurity = left * p * (1 - p) + (total - left) * q * (1 - q)
                k = int(np.argmin(impurity))
                if impurity[k] < best[0]:
                    best = (float(impurity[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            left = self._grow(x[low], y[low], depth + 1, nodes, rng)
            right = self._grow(x[~low], y[~low], depth + 1, nodes, rng)
            nodes[at] = (best[1], best[2], left, right, nodes[at][4])
        return at

    def vote(self, row: list[float]) -> float:
        total = 0.0
        for nodes in self.grown:
            n = nodes[0]
            while n[0] >= 0:
                n = nodes[n[2] if row[n[0]] <= n[1] else n[3]]
            total += n[4]
        return total / len(self.grown)


def train(findings=None, **options) -> Forest:
    found = labelled_findings() if findings is None else findings
    x = np.array([features(t, a, b, *path) for t, a, b, _, *path in found])
    return Forest(**options).fit(x, np.array([f[3] for f in found], float))


@lru_cache(1)
def default_forest() -> Forest:
    """The forest of the generated findings, trained once."""
    return train()


def assigned(text: str) -> list[tuple[int, int]]:
    """Values after secret names; unbroken ones without quotes and stops at their edges."""
    out, at = [], 0
    while m := ASSIGNED.search(text, at):
        begin, end = m.span(m.lastindex)
        at = begin  # the value may be a name itself
        if m.lastindex == 3:
            value = m.group(3)
            begin += len(value) - len(value.lstrip("\"'`("))
            end -= len(value) - len(value.rstrip("\"'`,;.:)]}>"))
        if begin < end:
            out.append((begin, end))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    runs = [m.span() for m in CANDIDATE.finditer(text) if MIXED.search(m.group())]
    if "://" in text:
        runs += [m.span(1) for m in ADDRESS.finditer(text)]
    if "-----BEGIN" not in text:
        return sorted({*runs, *assigned(text)})
    blocks = [m.span() for m in BLOCK.finditer(text)]
    apart = [(a, b) for a, b in {*runs, *assigned(text)} if not any(x <= a and b <= y for x, y in blocks)]
    return sorted([*apart, *blocks])


def scan(docs: DataFrame, text: str = "text", forest: Forest | None = None, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """doc_id, begin, end, score, secret_sha256: a row for each finding.  `path` names the column of the
    files' paths, if there is one."""
    forest = forest or default_forest()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "begin", "end", "score", "secret_sha256"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.string()]

    def run(batches):
        for batch in in_parts(batches, "raw", 8_000_000):
            rows, which = [], []
            for i, (raw, of) in enumerate(zip(batch.column("raw"), batch.column("path"))):
                whole = raw.as_py().decode("utf-8", "replace")
                for a, b in candidates(whole):
                    v = forest.vote(features(whole, a, b, of.as_py()))
                    if v >= threshold:
                        rows.append((a, b, round(v, 6), hashlib.sha256(whole[a:b].encode()).hexdigest()))
                        which.append(i)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    of = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")
    return small_batches(docs).select("doc_id", text_bytes(text).alias("raw"), of.alias("path")).mapInArrow(run, f"doc_id {kind}, begin long, end long, score double, secret_sha256 string")
