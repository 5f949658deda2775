"""The evaluation as text and JSON. Collects frames of a few rows: strata, classes, confusion cells."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from colloquy.operators.metrics import STRATA, Evaluation

#: Most classes, and most labels of the confusion matrix, that a report lists.
MOST_CLASSES, MOST_LABELS = 10_000, 1_000


class TooLarge(ValueError):
    """The report would not fit; write_tables has no such bound."""


def as_dict(e: Evaluation) -> dict:
    """{result, acceptance}: strata without records have n alone.

    A corpus with free names may have more classes or labels than a report can list: TooLarge is raised, nothing is cut.
    """
    rows = {r.stratum: {k: v for k, v in r.asDict().items() if k != "stratum"} for r in e.summary.collect()}
    strata = {s: rows[s] if rows[s]["n"] else {"n": 0} for s in STRATA}
    classes = e.per_class.limit(MOST_CLASSES + 1).collect()
    labels = _labels(e)
    if len(classes) > MOST_CLASSES or len(labels) > MOST_LABELS:
        raise TooLarge(f"more than {MOST_CLASSES} classes or {MOST_LABELS} labels: use write_tables")
    at = {(r.gold_label, r.pred_label): r.n for r in e.confusion.collect()}  # at most the labels squared
    return {
        "result": {
            "n_conversations": e.n_conversations.first().n_conversations,
            "n_scored_turns": strata["overall"]["n"],
            "strata": strata,
            "per_class": {r["class"]: {k: v for k, v in r.asDict().items() if k != "class"} for r in sorted(classes, key=lambda r: r["class"])},
            "confusion": {"labels": labels, "matrix": [[at.get((g, p), 0) for p in labels] for g in labels]},
        },
        "acceptance": e.verdict.first().asDict(),
    }


def _labels(e: Evaluation) -> list[str]:
    names = e.confusion.select(F.explode(F.array("gold_label", "pred_label")).alias("l")).distinct()
    return sorted(r.l for r in names.limit(MOST_LABELS + 1).collect())


def write_tables(e: Evaluation, folder: str) -> None:
    """The frames of an evaluation as Parquet below ``folder``, whatever their size."""
    for name in ("summary", "per_class", "confusion", "verdict"):
        getattr(e, name).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def _cell(value: object) -> str:
    return "  n/a" if value is None else f"{value:6.3f}" if isinstance(value, float) else f"{value!s:>6}"


def as_text(report: dict) -> str:
    """Tables of fixed width: strata, classes by falling support, confusion, verdict."""
    result, lines = report["result"], []
    lines.append(f"{result['n_conversations']} conversations, {result['n_scored_turns']} turns scored")
    names = ("n", "exact_match", "mean_jaccard", "kappa", "macro_f1", "micro_f1")
    lines.append(f"{'stratum':<16}" + "".join(f"{n:>14}" for n in names))
    lines += [f"{s:<16}" + "".join(f"{_cell(row.get(n)):>14}" for n in names) for s, row in result["strata"].items()]
    lines.append(f"{'class':<24}{'precision':>10}{'recall':>10}{'f1':>10}{'support':>10}")
    for name, row in sorted(result["per_class"].items(), key=lambda x: (-x[1]["support"], x[0])):
        lines.append(f"{name:<24}{row['precision']:>10.3f}{row['recall']:>10.3f}{row['f1']:>10.3f}{row['support']:>10}")
    labels = result["confusion"]["labels"]
    lines.append(f"{'gold / pred':<12}" + "".join(f"{x[:8]:>10}" for x in labels))
    lines += [f"{g[:10]:<12}" + "".join(f"{n:>10}" for n in row) for g, row in zip(labels, result["confusion"]["matrix"])]
    v = report["acceptance"]
    lines.append(f"{'PASS' if v['accepted'] else 'FAIL'}: kappa {_cell(v['kappa']).strip()} of {v['least_kappa']}, exact {_cell(v['exact_match']).strip()} of {v['least_exact']}")
    return "\n".join(lines)


def write_report(report: dict, path: str | Path) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(report, ensure_ascii=False, indent=2), encoding="utf-8")
