"""Secret scan with multipart credential linking.

A credential seldom stands alone: an access identifier, a secret and an endpoint
lie close together. Strong spans (an assignment to a secret-like name, a cloud
access key, a long hex string) are always reported. Weak parts (an identifier
assignment, a random-looking token, an endpoint) are reported only where an
interval join within one scope finds the parts that complete them:

* a weak identifier needs a secret (strong or weak),
* a weak secret needs an access identifier (strong or weak),
* an endpoint needs both an identifier and a secret.

A scope is a block of text between blank lines; within it two parts meet if the
gap between their spans is at most ``reach`` code points. A scope never leaves
its row, so the join needs no shuffle: every task sorts the parts of one text
and looks the interval up by bisection, in O(parts * log parts).

Defined results: a null text counts as empty; an empty text has no spans;
repeated rows are scanned each for itself; columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import per_batch, schema, table

# The kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
BASE = KINDS[:3]

# The base patterns. "(?a)" keeps case folding to ASCII letters.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run below 16 characters holds no later match either
HEX = re.compile(r"[0-9a-f]{32,}")  # leftmost, greedy: whole runs
ASSIGN_NEEDS = ("passw", "secret", "token", "api")

# The weak patterns.
WEAK_ID = re.compile(r"""(?ai)\b(?:access_?key(?:_?id)?|key_?id|client_?id|account(?:_?id)?|user(?:name)?|login)"""
                     r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""")
WEAK_ID_NEEDS = ("key", "client", "account", "user", "login")
ENDPOINT = re.compile(r"""(?ai)\b(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?:host(?:name)?|endpoint|server)["']?"""
                      r"""\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]{1,5})?|[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{1,5}\b)""")
ENDPOINT_NEEDS = ("://", "host", "endpoint", "server", ".")
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BLANK = re.compile(r"\n[ \t\r]*\n")

REACH = 300


def _random_looking(token: str) -> bool:
    """At least 12 different characters, letters and digits mixed."""
    return len(set(token)) >= 12 and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def base_spans(text: str, lower: str) -> list[tuple[int, int, str]]:
    found = []
    if any(k in lower for k in ASSIGN_NEEDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


class _Parts:
    """Spans of one role, for interval lookups within a scope."""

    def __init__(self, spans: list[tuple[int, int]], scopes: list[int]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.scope = [bisect_right(scopes, s) for s in self.starts]
        self.reach_end: list[int] = []  # the furthest end so far within the scope
        for (_, end), k, scope in zip(spans, range(len(spans)), self.scope, strict=True):
            before = self.reach_end[-1] if k and self.scope[k - 1] == scope else -1
            self.reach_end.append(max(before, end))

    def near(self, start: int, end: int, scope: int, reach: int) -> bool:
        """Whether a part of this scope lies within ``reach`` of [start, end)."""
        k = bisect_right(self.starts, end + reach) - 1  # the last part that begins early enough
        while k >= 0 and self.scope[k] > scope:
            k = bisect_left(self.scope, scope + 1) - 1
        return k >= 0 and self.scope[k] == scope and self.reach_end[k] >= start - reach


def find_spans(text: str, reach: int = REACH) -> list[tuple[int, int, str]]:
    """All spans of one text as (start, end, kind) in code points, by start and then kind."""
    lower = text.lower()
    base = base_spans(text, lower)
    access = [(s, e) for s, e, k in base if k == "access"]
    strong = [(s, e) for s, e, k in base if k != "access"]

    def free(spans, *others):
        """Those that overlap none of the others."""
        taken = sorted(x for o in others for x in o)
        starts, ends, far = [s for s, _ in taken], [], -1
        for _, e in taken:
            far = max(far, e)
            ends.append(far)
        return [(s, e) for s, e in spans if not (k := bisect_left(starts, e)) or ends[k - 1] <= s]

    ids = free([m.span() for m in WEAK_ID.finditer(text)], access, strong) if any(k in lower for k in WEAK_ID_NEEDS) else []
    found = list(base)
    if ids or access:
        ends = free([m.span() for m in ENDPOINT.finditer(text)], access, strong, ids) if any(k in lower for k in ENDPOINT_NEEDS) else []
        tokens = free([m.span() for m in RANDOM.finditer(text) if _random_looking(m[0])], access, strong, ids, ends)
        scopes = [m.end() for m in BLANK.finditer(text)]
        who, what = _Parts(access + ids, scopes), _Parts(strong + tokens, scopes)
        for kind, spans, needs in (("id", ids, (what,)), ("secret", tokens, (who,)), ("endpoint", ends, (who, what))):
            for s, e in spans:
                scope = bisect_right(scopes, s)
                if all(p.near(s, e, scope, reach) for p in needs):
                    found.append((s, e, kind))
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, end)."""
    import pyarrow as pa

    def make():
        def fn(batch):
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in find_spans(t or "", reach)]
                     for t in batch.column(1).to_pylist()]
            return [batch.column(0), pa.array(spans, _SPANS)]
        return fn

    _SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    out = schema(docs, id_col, "spans array<struct<kind:string,start:bigint,end:bigint>>")
    return per_batch(docs.select(id_col, text_col), make, out)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """All rows and columns of ``docs``; spans in the text are replaced by ``mark``
    (overlapping spans by one), ``n_chars``, where there is such a column, follows. Null texts stay null."""
    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if not isinstance(text, str):
                return None
            out, at = [], 0
            for s, e, _ in find_spans(text, reach):
                if s >= at:
                    out += [text[at:s], mark]
                at = max(at, e)
            return "".join(out) + text[at:] if out else text
        return texts.map(one)

    done = docs.withColumn(text_col, clean(text_col))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars"))
                               .otherwise(F.char_length(text_col)).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"), *[count(k) for k in KINDS[3:]])
