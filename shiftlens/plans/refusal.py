"""Refusals: a code, what shows it, and what to do next."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from shiftlens.functions.formats import byte_name, ident_human, ident_json, with_commas

PROGRAM = "shiftlens"

#: Codes and their reasons.
REASONS = {
    "E_IO": "file read error",
    "E_ENCODING": "unsupported text encoding",
    "E_CSV_PARSE": "CSV parse failure",
    "E_HEADERS": "invalid or duplicate headers",
    "E_NO_KEY": "key column missing",
    "E_KEY_EMPTY": "empty key value",
    "E_KEY_DUP": "duplicate key values",
    "E_KEY_MISMATCH": "key sets differ",
    "E_ROWCOUNT": "row count mismatch",
    "E_NEED_KEY": "cannot deterministically align without a key",
    "E_DIALECT": "delimiter ambiguous or undetectable",
    "E_AMBIGUOUS_PROFILE": "ambiguous profile selectors",
    "E_PROFILE_NOT_FOUND": "profile could not be resolved",
    "E_PROFILE_REGISTRY": "profile column registry could not be loaded",
    "E_KEY_CONFLICT": "key flag conflicts with profile key",
    "E_MIXED_TYPES": "mixed numeric and non-numeric values",
    "E_NO_NUMERIC": "no numeric columns in common",
    "E_MISSINGNESS": "numeric-vs-missing mismatch (refusal)",
    "E_DIFFUSE": "diffuse change below coverage threshold",
    "E_AUDIT_LIMIT": "audit output limit exceeded",
    "E_AUDIT_FIELDS_REQUIRES_EXHAUSTIVE": "field audit requires exhaustive mode",
    "E_AUDIT_FIELDS_REQUIRES_PROFILE": "field audit requires an active profile",
}


@dataclass
class Refused(Exception):
    """No verdict can be given. ``detail`` holds plain values; bytes are identifiers."""

    code: str
    detail: dict[str, Any] = field(default_factory=dict)
    counts: dict[str, int | None] = field(default_factory=dict)
    metrics: dict[str, float | None] = field(default_factory=dict)

    @property
    def reason(self) -> str:
        return REASONS[self.code]

    def detail_json(self) -> dict[str, Any]:
        def shown(v: Any) -> Any:
            return ident_json(v) if isinstance(v, bytes) else [shown(x) for x in v] if isinstance(v, list) else v

        return {k: shown(v) for k, v in self.detail.items() if k != "hint"}

    def next_step(self, old: str, new: str) -> str:
        d, rerun = self.detail, f"{PROGRAM} {old} {new}"
        keys = d.get("suggested_keys") or []
        match self.code:
            case "E_IO":
                return "check that both paths exist and can be read, then rerun"
            case "E_ENCODING":
                return "export both files as UTF-8 CSV and rerun"
            case "E_CSV_PARSE":
                return "export as standard CSV with RFC 4180 quoting and rerun"
            case "E_HEADERS":
                return {
                    "missing_header": "give the file a header row and rerun",
                    "duplicate": "make header names unique and rerun",
                    "extra_fields": "remove the extra fields or export with matching headers, then rerun",
                }[d["issue"]]
            case "E_NO_KEY":
                return f"{rerun} --key {ident_json(d['key_column'])} once both files have that column"
            case "E_KEY_EMPTY":
                return "choose a key column without empty values, or fill them in, then rerun"
            case "E_KEY_DUP":
                return "choose a unique key column or remove duplicates, then rerun"
            case "E_KEY_MISMATCH":
                return "export the same scope on both sides or fix the key, then rerun"
            case "E_ROWCOUNT" | "E_NEED_KEY":
                return f"{rerun} --key {ident_json(keys[0])}" if keys else "rerun with --key <column>"
            case "E_DIALECT":
                return f"{rerun} {d['suggestion']}" if d["suggestion"].startswith("--") else f"put `{d['suggestion']}` on the first line of the {d['file']} file, then rerun"
            case "E_AMBIGUOUS_PROFILE":
                return "give one of --profile and --profile-id, then rerun"
            case "E_PROFILE_NOT_FOUND":
                return f"check the profile folder for profile_id={d['profile_id']!r} or rerun with --profile <path>"
            case "E_PROFILE_REGISTRY":
                return "fix the profile's column_registry or its files, then rerun"
            case "E_KEY_CONFLICT":
                return "leave out --key, as the profile names one, or use a profile without a key"
            case "E_MIXED_TYPES":
                return "make the column's values numeric or leave the column out, then rerun"
            case "E_NO_NUMERIC":
                return "make sure that both files share numeric columns, then rerun"
            case "E_MISSINGNESS":
                return "fill in missing values or leave the column out, then rerun"
            case "E_DIFFUSE":
                return f"{rerun} --threshold 0.80"
            case "E_AUDIT_LIMIT":
                return f"{rerun} --exhaustive --max-audit-changes {d['changed_cells']}"
            case "E_AUDIT_FIELDS_REQUIRES_EXHAUSTIVE":
                return f"{rerun} --exhaustive --audit-fields"
        return "rerun with --exhaustive --audit-fields and a profile"

    def example(self, names: dict[str, str]) -> str:
        """One line with the case at hand."""
        d = self.detail
        who = names.get(d.get("file") or "", d.get("file"))
        ids = lambda k: ", ".join(ident_human(x) for x in d.get(k) or [])
        one = lambda k: ident_human(d[k])
        match self.code:
            case "E_IO":
                return f"{who} file error: {d['error']}."
            case "E_ENCODING":
                return f"{who} contains {d['issue']}."
            case "E_CSV_PARSE":
                return f"{who} parse error (line unknown)." if d.get("line") is None else f"{who} parse error at line {d['line']}."
            case "E_HEADERS" if d["issue"] == "missing_header":
                return f"{who} has no header row."
            case "E_HEADERS" if d["issue"] == "duplicate":
                return f'{who} has duplicate header "{one("name")}".'
            case "E_HEADERS":
                return f"{who} data record {with_commas(d['record'])} has more fields than the header."
            case "E_NO_KEY":
                return f'key column "{one("key_column")}" not found in one or both files.'
            case "E_KEY_EMPTY":
                return f'{who} data record {with_commas(d["record"])} has empty key in column "{one("column")}".'
            case "E_KEY_DUP":
                return f'{who} data record {with_commas(d["record"])} duplicates key "{one("key")}".'
            case "E_KEY_MISMATCH":
                line = f"missing_in_new={with_commas(d['missing_in_new'])} extra_in_new={with_commas(d['extra_in_new'])}."
                line += f" missing samples: [{ids('missing_samples')}]." if d["missing_samples"] else ""
                return line + (f" extra samples: [{ids('extra_samples')}]." if d["extra_samples"] else "")
            case "E_ROWCOUNT":
                line = f"{with_commas(d['rows_old'])} records against {with_commas(d['rows_new'])}."
                return line + (f" columns that can be keys: {ids('suggested_keys')}." if d["suggested_keys"] else "")
            case "E_NEED_KEY":
                return f"the same records stand in another order; columns that can be keys: {ids('suggested_keys')}."
            case "E_DIALECT":
                return f"{who} reads equally well with several delimiters: {', '.join(byte_name(ord(x)) for x in d['tied_delimiters'])}."
            case "E_AMBIGUOUS_PROFILE":
                return f'both --profile "{d["profile_path"]}" and --profile-id "{d["profile_id"]}" were provided.'
            case "E_PROFILE_NOT_FOUND":
                return f'profile "{d["profile_id"]}" was not found.'
            case "E_PROFILE_REGISTRY":
                at = f' file "{d["file"]}"' if d.get("file") else ""
                return f'profile "{d["profile"]}" column_registry "{d["column_registry"]}"{at} failed: {d["reason"]}.'
            case "E_KEY_CONFLICT":
                return f'--key "{d["key_flag"]}" conflicts with profile key [{", ".join(d["profile_key"])}].'
            case "E_MIXED_TYPES" | "E_MISSINGNESS":
                what = "non-numeric" if self.code == "E_MIXED_TYPES" else "numeric"
                tail = "." if self.code == "E_MIXED_TYPES" else " while the other side is missing."
                where = f'key "{one("key")}"' if "key" in d else f"{who} data record {with_commas(d['record'])}"
                return f'{where} column "{one("column")}" has {what} value "{one("value")}"{tail}'
            case "E_DIFFUSE":
                return f"the largest changes explain {d['top_k_coverage'] * 100:.1f}% of the total, the threshold is {d['threshold'] * 100:.1f}%."
            case "E_AUDIT_LIMIT":
                return f"{with_commas(d['changed_cells'])} changes exceed the limit of {with_commas(d['max_audit_changes'])}."
        return f"{self.reason}."
