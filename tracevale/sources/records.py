"""The ten persisted record kinds: schemas, domains, reading with checks, and keyed writing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import list_repr, stable_id

BASE = "id string, schema_version string, run_id string, source string, source_revision string, "
#: Own fields of each kind.
OWN = {
    "screens": "url string, route_pattern string, title string, dom_artifact string, screenshot_artifact string, visible_text_hash string",
    "elements": "screen_id string, role string, name string, locator_evidence map<string,string>, attributes map<string,string>, bounds array<double>",
    "interactions": "source_state_id string, target_state_id string, element_id string, action string, input_class string, timestamp timestamp, success boolean",
    "flows": "goal string, interaction_ids array<string>, start_state_id string, end_state_id string, discovery_source string",
    "requirements": "statement string, actor string, action string, object string, acceptance_clues array<string>, source_span struct<uri:string,heading_path:array<string>,quote:string,start_offset:int,end_offset:int>, testable boolean",
    "code_symbols": "repo_sha string, file string, qualified_name string, kind string, line_start int, line_end int, ui_anchors array<string>",
    "pr_changes": "pr_number int, title string, base_sha string, head_sha string, merge_commit_sha string, file string, change_type string, patch string, changed_symbol_ids array<string>",
    "trace_links": "source_entity_id string, target_entity_id string, link_type string, confidence double, method string, evidence array<string>, review_status string",
    "absences": "requirement_id string, crawl_run_id string, search_scope string, expected_evidence array<string>, confidence double, explanation string",
    "impacts": "changed_symbol_id string, path_entity_ids array<array<string>>, affected_entity_ids array<string>, severity string, confidence double, summary string",
}
#: Allowed words.
DOMAINS = {
    ("interactions", "action"): "click fill select navigate submit", ("flows", "discovery_source"): "llm_goal deterministic manual",
    ("code_symbols", "kind"): "function method type template template_block ts_module route", ("pr_changes", "change_type"): "added modified deleted renamed",
    ("trace_links", "link_type"): "implements rendered_by handled_by supports uses", ("trace_links", "review_status"): "auto_accepted needs_review unresolved",
    ("impacts", "severity"): "high medium low",
}
NULLABLE = {"bounds", "input_class", "merge_commit_sha"}


def schema(kind: str) -> str:
    return BASE + OWN[kind]


def natural_key(kind: str) -> Column:
    """The id that a record's own content gives."""
    c = F.col
    keys = {
        "screens": ("screen", c("url"), c("visible_text_hash")), "elements": ("element", c("screen_id"), c("role"), c("name")),
        "interactions": ("interaction", c("source_state_id"), c("element_id"), c("action"), c("target_state_id")), "flows": ("flow", c("goal"), c("start_state_id"), c("end_state_id")),
        "requirements": ("requirement", c("source_span.uri"), c("statement")), "code_symbols": ("symbol", c("repo_sha"), c("file"), c("qualified_name")),
        "pr_changes": ("pr_change", c("pr_number"), c("file")), "trace_links": ("trace_link", c("source_entity_id"), c("target_entity_id"), c("link_type")),
        "absences": ("absence", c("requirement_id"), c("crawl_run_id")), "impacts": ("impact", c("changed_symbol_id"), list_repr(c("affected_entity_ids"))),
    }
    return stable_id(*keys[kind])


def read_records(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Records of a folder of JSON files, in one scan; a missing folder is an empty table, and a malformed file an error."""
    try:
        return spark.read.schema(schema(kind)).option("multiLine", True).option("mode", "FAILFAST").json(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema(kind))


def unknown_fields(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(file, field) of fields that the kind doesn't have."""
    known = [x.split()[0] for x in _split(schema(kind))]
    raw = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("file"), F.explode(F.json_object_keys("value")).alias("field"))
    return raw.where(~F.col("field").isin(known))


def _split(ddl: str) -> list[str]:
    out, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


def violations(records: DataFrame, kind: str) -> DataFrame:
    """(id, problem): missing values, words outside their domain, confidences outside 0 to 1."""
    problems = [F.when(F.col(f).isNull(), F.lit(f"{f} is missing")) for f in (x.split()[0] for x in _split(schema(kind))) if f not in NULLABLE]
    problems += [F.when(~F.col(f).isin(*words.split()), F.concat(F.lit(f"{f}: "), F.col(f))) for (k, f), words in DOMAINS.items() if k == kind]
    if "confidence" in records.columns:
        problems.append(F.when(~F.col("confidence").between(0, 1), F.lit("confidence is out of range")))
    return records.select("id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def save_records(records: DataFrame, path: str) -> None:
    """One row for each id; the greatest run_id wins, as a later save overwrites an earlier one."""
    from ..operators.graph import merge_latest

    merge_latest(records, ["id"], "run_id").write.mode("overwrite").parquet(path)
