"""The Markdown report against a plain rendering."""

import pytest

from tracevale.operators import lookups, report

FOUND = "id string, changed_symbol_id string, severity string, confidence double, files string, affected_entity_ids array<string>, path_entity_ids array<array<string>>"
EMPTY = {"pr": {"pr_number": 7}}
FULL = {"pr": {"pr_number": 37, "title": "A title", "url": "https://x/y", "files_changed": 3, "base_sha": "0123456789", "head_sha": "abcdefghij"}, "stats": {"flows": 4, "requirements": 2}, "run_id": "run-1", "source_revision": "rev", "generated_at": "now"}
ENTITIES = {
    "element": [("e1", "Save  it"), ("e2", "Save it"), ("e3", ""), ("e4", "x" * 50), *((f"m{i}", f"name {i}") for i in range(7))],
    "screen": [("s1", "/a"), ("s2", "/b/" + "y" * 60), ("s3", "/a")],
    "flow": [("f1", "Open an issue", ["i", "j"]), ("f2", None, None)],
    "requirement": [("r1", "A user can  save"), ("r2", "Other")],
}
FINDINGS = [
    ("b", "c1", "medium", 0.845, "a.go, b.go", ["e1", "e2", "s1", "f1"], [["c1", "e2", "s1", "f1"], ["c1", "e1"]]),
    ("a", "c2", "high", 0.5, "c.go", ["e3", "e4", *(f"m{i}" for i in range(7)), "s1", "s2", "s3", "f2", "f1", "r2", "r1"], None),
    ("c", "c3", "low", 0.125, None, ["unknown"], [["c3", f"p{i}"] for i in range(9)]),
]
UNMAPPED = [("z.go", "modified", "no UI link found"), ("b.go", None, None), (None, "added", "")]


def listed(names, most):
    return ", ".join(names[:most]) + (f", and {len(names) - most} more" if len(names) > most else "")


def plain(findings, unmapped, context):
    pr, stats = context.get("pr", {}), context.get("stats", {})
    label = {k: {r[0]: " ".join((r[1] or "").split()) for r in rows} for k, rows in ENTITIES.items()}
    steps = {f: len(x or []) for f, _, x in ENTITIES["flow"]}
    badge = {"high": "🔴 HIGH", "medium": "🟠 MEDIUM", "low": "🟡 LOW"}
    total, parts = {k: set() for k in label}, []
    for i, symbol, severity, confidence, files, affected, paths in sorted(findings, key=lambda f: (["high", "medium", "low"].index(f[2]), f[0])):
        ids = list(dict.fromkeys([x for p in paths or [] for x in p] + affected))
        own = {k: [x for x in ids if x in label[k]] for k in label}
        for k in total:
            total[k] |= set(own[k])
        names = [label["element"][x] or "Unnamed element" for x in own["element"]]
        names = [n if len(n) <= 40 else n[:39] + "…" for n in names]
        names = [f"{n} ({names.count(n)} places)" if names.count(n) > 1 else n for n in dict.fromkeys(names)]
        routes = list(dict.fromkeys(label["screen"][x] for x in own["screen"]))
        evidence = paths or [[symbol, x] for x in affected]
        text = f"### {badge[severity]} — {files or 'unknown file'}\n\nChanges to {files or 'unknown file'} affect {listed(names, 6) or 'screen behavior'}"
        text += f" across {listed(routes, 5)}.\n\n" if routes else ".\n\n"
        if own["flow"]:
            text += "Affected user flows: " + "; ".join(label["flow"][x] or "Unnamed flow" for x in own["flow"]) + "\n\n"
        text += f"Confidence: {round(confidence * 100)}%.\n\nEvidence: `" + "`; `".join(" → ".join(p) for p in evidence[:5]) + "`\n"
        text += f"\n… plus {len(evidence) - 5} more recorded paths (see impact records).\n" if len(evidence) > 5 else ""
        parts.append(text + "\n\n")
    sha = [pr.get(k) or "unknown" for k in ("base_sha", "head_sha")]
    ingested = bool(stats.get("requirements"))
    out = f"# Blast-radius report: PR #{pr.get('pr_number', 'unknown')}\n\n## What changed\n\n[{pr.get('title') or 'Untitled pull request'}]({pr.get('url') or '#'}) changes {pr.get('files_changed') or 0} files from `{sha[0][:8]}` to `{sha[1][:8]}`.\n\n"
    out += f"## Executive summary\n\n{len(findings)} changed code areas map to {len(total['element'])} UI elements across {len(total['screen'])} screens. {len(total['flow'])} of {stats.get('flows') or 0} discovered user flows touch affected elements or screens.\n\n"
    out += f"{len(total['requirement'])} ingested requirements are linked to affected UI." if ingested else "No requirements were ingested in this run, so requirement-level coverage is not assessed."
    out += "\n\n## Impacts by risk\n\n" + ("".join(parts) or "No code-to-UI impacts were found from accepted or review-pending links.\n\n") + "## User flows to re-test\n\n"
    out += "".join(f"- {label['flow'][f] or 'Unnamed flow'} ({steps[f]} steps)\n" for f in sorted(total["flow"])) or "No discovered user flows are linked to the affected UI.\n"
    out += "\n## Requirements at risk\n\n"
    if ingested:
        statement = {r[0]: r[1] for r in ENTITIES["requirement"]}
        out += "".join(f"- {statement[r]}\n" for r in sorted(total["requirement"])) or "No ingested requirements are linked to the affected UI.\n"
    else:
        out += "No requirements were ingested in this run; requirement-level coverage is not assessed.\n"
    out += "\n## Not mapped to UI\n\n"
    if unmapped:
        out += "These changed files could not be mapped to the discovered UI and remain explicit uncertainty:\n\n"
        out += "".join(f"- `{f or 'unknown file'}` ({c or 'changed'}): {r or 'mapping unavailable'}\n" for f, c, r in sorted(unmapped, key=lambda u: (u[0] or "", u[1] or "")))
    else:
        out += "Every changed file had at least one accepted or review-pending UI link.\n"
    run = [context.get(k) or "unknown" for k in ("run_id", "source_revision", "generated_at")]
    return out + f"\n## Run identifiers\n\n- Run ID: `{run[0]}`\n- Source revision: `{run[1]}`\n- PR base SHA: `{sha[0]}`\n- PR head SHA: `{sha[1]}`\n- Generated at: {run[2]}\n"


@pytest.mark.parametrize(("findings", "unmapped", "context"), [(FINDINGS, UNMAPPED, FULL), (FINDINGS[:1], [], EMPTY), ([], UNMAPPED[:1], FULL), ([], [], {})])
def test_report(spark, findings, unmapped, context):
    tables = {k: spark.createDataFrame(rows, f"id string, {lookups.NAMES[k][0]} string" + (", interaction_ids array<string>" if k == "flow" else "")) for k, rows in ENTITIES.items()}
    got = report.markdown(spark.createDataFrame(findings, FOUND), spark.createDataFrame(unmapped, "file string, change_type string, reason string"), lookups.entity_labels(tables), context)
    assert got == plain(findings, unmapped, context)
