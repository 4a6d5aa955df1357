"""Search over strategy documents with placeholders: each generation is one sweep over all its variants."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .strategy import ERROR, fitness, sound, sweep

# What numbers of genes for columns and for the freq stand for, and the weights of two kinds of fitness.
COLUMNS = ["close", "open", "low", "high"]
FREQUENCIES = ["1Min", "5Min", "15Min", "30Min", "1h", "4h", "8h", "12h"]
PRESETS = {
    "aggressive": {"return_perc": 0.5, "market_adjusted_return": 0.3, "sharpe_ratio": 0.1, "drawdown_metrics.max_drawdown_pct": -0.2, "num_trades": 0.1},
    "conservative": {"return_perc": 0.2, "market_adjusted_return": 0.2, "sharpe_ratio": 0.3, "drawdown_metrics.max_drawdown_pct": -0.4, "num_trades": 0.1, "risk_metrics.sortino_ratio": 0.2},
}


def substituted(document, genes: Mapping[str, object]):
    """The document with every text "#name" replaced by the gene of that name; genes that are functions are called at each place. Unknown names stay."""
    if isinstance(document, str) and document.startswith("#"):
        value = genes.get(document[1:], document)
        return value() if callable(value) else value
    if isinstance(document, Mapping):
        return {k: substituted(v, genes) for k, v in document.items()}
    if isinstance(document, (list, tuple)):
        return [substituted(v, genes) for v in document]
    return document


def with_genes(document: Mapping, genes: Mapping[str, object], columns: bool = False) -> dict:
    """A strategy document with its genes filled in. Arguments of datapoints become whole numbers; A gene named freq is a frequency or its number. ``columns``: numbers of genes named after a column choose one of four."""
    if columns:
        chosen = {k: v() if callable(v) else v for k, v in genes.items()}
        genes = {k: COLUMNS[int(v) % 4] if "column" in k and isinstance(v, (int, float)) else v for k, v in chosen.items()}
    out = substituted(document, genes)
    if "freq" in genes:
        freq = genes["freq"]() if callable(genes["freq"]) else genes["freq"]
        out["freq"] = freq if freq in FREQUENCIES else FREQUENCIES[max(0, min(int(freq), len(FREQUENCIES) - 1))]
    for d in out.get("datapoints") or []:
        if "args" in d:
            d["args"] = [round(a) if isinstance(a, float) else a for a in d["args"]]
    return out


def with_mods(document: Mapping, mods: Mapping[str, object]) -> dict:
    """The document with some of its keys set anew."""
    return {**document, **mods}


def search(bars: DataFrame, document: Mapping, genes: Mapping[str, Callable[[random.Random], object]], weights: Mapping[str, float], size: int = 50, generations: int = 1, keep: int = 5, seed: int = 0, min_trades: int = 5) -> list[tuple[dict, float]]:
    """The ``keep`` best sets of genes with their mean fitness over all symbols.

    A generation is ``size`` variants in one job; only one number a variant comes
    back. Each gene is drawn by its function; from the second generation on, half
    of a variant's genes are those of one of the best so far. A variant that can't
    be run has the fitness ``ERROR``.
    """
    rng = random.Random(seed)
    best: list[tuple[dict, float]] = []
    for _ in range(generations):
        tried = []
        for _ in range(size):
            drawn = {k: draw(rng) for k, draw in genes.items()}
            parent = rng.choice(best)[0] if best else {}
            tried.append({k: parent[k] if k in parent and rng.random() < 0.5 else v for k, v in drawn.items()})
        variants = {str(k): with_genes(document, g) for k, g in enumerate(tried)}
        good, bad = sound(variants)
        scored = sweep(bars, {n: variants[n] for n in good}).groupBy("variant").agg(F.avg(fitness(dict(weights), min_trades)).alias("fitness")).collect() if good else []
        best += [(tried[int(r["variant"])], r["fitness"]) for r in scored] + [(tried[int(n)], ERROR) for n in bad]
        best = sorted({str(sorted(g.items())): (g, f) for g, f in best}.values(), key=lambda x: (-x[1], str(x[0])))[:keep]
    return best
