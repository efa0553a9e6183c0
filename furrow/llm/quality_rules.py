"""Host-level quality rules.

Every document is measured and judged by rules of its own; failures are summed by host for each rule; the hosts' failure
rates are shrunk with a beta prior that is estimated from all hosts; a host whose shrunk rate passes a rule's limit is
rejected, and its verdict goes back to all its documents.

Null texts have no words and fail. Documents without a host are judged by their own rules only. Repeated rows count as
often as they are there. With a single host, or without any failure, the prior weighs one document. An empty table gives
an empty one. Columns of the input are carried; one with the name of a result column is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import WHITE, row_total, unused, with_results
from furrow.session import cut_lineage

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
#: Words of a window in the test for repetition.
WINDOW = 5

#: A rule fails where its condition is true. `base` is what a document must pass itself; the others only count by host.
RULES: dict[str, str] = {
    "base": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "2 * n_dup_lines > n_lines",
    "length": "word_chars > 20 * n_words",
}
#: A host is rejected if a rule's shrunk failure rate is above this.
MOST = 0.5
#: Hosts whose verdicts (some ten bytes and a name each) are sent to every task; more are joined by shuffle.
SENT_HOSTS = 200_000
#: Documents that the prior weighs: at least, and at most.
STRENGTH = (1.0, 1e6)


def repeated_words(tokens: list[bytes]) -> int:
    """Words in windows of five that the text holds twice or more, the first included."""
    n = len(tokens)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    code = np.array(list(map(seen.setdefault, tokens, range(n))), np.int64)
    if len(seen) == n:
        return 0
    # Exact ids of pairs, then of fours, then of fives: each combines two smaller ones.
    pair = np.unique(code[:-1] * n + code[1:], return_inverse=True)[1]
    four = np.unique(pair[:-2] * n + pair[2:], return_inverse=True)[1]
    five, count = np.unique(four[:-1] * n + code[4:], return_inverse=True, return_counts=True)[1:]
    first = np.flatnonzero(count[five] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    tokens = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    plain = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    return (len(tokens), plain, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
            repeated_words(tokens))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measures of each text (long) and a boolean failed_<rule> for each rule."""
    made = with_results(docs, text, dict.fromkeys(MEASURES, "bigint"), lambda values: [measure(t or "") for t in values])
    return made.withColumns({f"failed_{r}": F.expr(c) for r, c in RULES.items()})


def prior(hosts: DataFrame, rule: str) -> tuple[float, float]:
    """Beta parameters of the hosts' failure rates by the method of moments, hosts weighted by their documents.

    One row comes to the driver. The spread between hosts beyond what chance explains sets the prior's strength.
    """
    f, n = F.col(f"f_{rule}").cast("double"), F.col("n").cast("double")
    k, docs, failed, squares, fit = hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(f), F.sum(n * n), F.sum(f * f / n)).first()
    if not k:
        return 0.5, 0.5
    mean = failed / docs
    room = mean * (1 - mean)
    free = docs - squares / docs - (k - 1)
    strength = STRENGTH[0]
    if room > 0 and free > 0:
        between = (fit - docs * mean * mean - room * (k - 1)) / (room * free)
        strength = 1 / between - 1 if between > 0 else STRENGTH[1]
    strength = min(max(strength, STRENGTH[0]), STRENGTH[1])
    return mean * strength, (1 - mean) * strength


def host_verdicts(rows: DataFrame, host: str = "source", most: float = MOST) -> DataFrame:
    """(host, n, f_<rule>, rate_<rule>, host_kept) of each host in measured rows."""
    hosts = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"failed_{r}").cast("long")).alias(f"f_{r}") for r in RULES))
    hosts = cut_lineage(hosts)  # a row per host, read for each rule's prior and again for the verdicts
    for rule in RULES:
        a, b = prior(hosts, rule)
        hosts = hosts.withColumn(f"rate_{rule}", (F.col(f"f_{rule}") + F.lit(a)) / (F.col("n") + F.lit(a + b)))
    return hosts.withColumn("host_kept", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) <= F.lit(most))


def judged(rows: DataFrame, host: str = "source", most: float = MOST) -> DataFrame:
    """Measured rows with base_failed and kept. `rows` is read twice: for the hosts, and for the documents.

    The join is by host. The hosts are counted: up to SENT_HOSTS verdicts are broadcast; beyond that, adaptive execution
    splits a hot host's documents.
    """
    of, passed = unused(rows, "verdict_host"), unused(rows, "verdict_kept")
    verdict = host_verdicts(rows, host, most).select(F.col("host").alias(of), F.col("host_kept").alias(passed))
    if row_total(verdict) <= SENT_HOSTS:
        verdict = F.broadcast(verdict)
    joined = rows.join(verdict, F.col(host) == F.col(of), "left")
    return joined.withColumn("base_failed", F.col("failed_base")).withColumn(
        "kept", ~F.col("failed_base") & F.coalesce(passed, F.lit(True))).drop(of, passed)
