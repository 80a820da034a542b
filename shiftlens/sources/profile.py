"""Column profiles and their registries."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from shiftlens.functions.formats import parse_identifier
from shiftlens.plans.refusal import Refused

from .paths import profile_folder


@dataclass(frozen=True)
class Registry:
    reference: str
    resolved: str
    hash: str
    aliases: dict[bytes, bytes]
    files: tuple[tuple[str, bytes], ...] = ()


@dataclass(frozen=True)
class Profile:
    include: tuple[bytes, ...] | None = None
    key: tuple[bytes, ...] = ()
    key_labels: tuple[str, ...] = ()
    profile_id: str | None = None
    sha256: str | None = None
    column_registry: str | None = None
    path: str | None = None
    registry: Registry | None = field(default=None, compare=False)


def unquote(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'" else text


def name_bytes(text: str) -> bytes:
    try:
        return parse_identifier(text)
    except ValueError:
        return text.encode()


def parse_profile(text: str) -> Profile:
    """A small part of YAML: scalars, inline and dashed lists; ``#`` starts a comment anywhere; other lines are ignored."""
    scalars: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    current = None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        if m := re.match(r"\s*-\s*(.*)$", line):
            if current:
                lists[current].append(unquote(m[1]))
            continue
        current = None
        m = re.match(r"([A-Za-z0-9_]+)\s*:\s*(.*)$", line.strip())
        if not m:
            continue
        name, rest = m[1], m[2].strip()
        if name in ("include_columns", "key"):
            lists[name] = []
            if rest.startswith("["):
                lists[name] = [unquote(x) for x in rest.strip("[]").split(",") if x.strip()]
            elif rest:
                lists[name] = [unquote(rest)]
            else:
                current = name
        elif name in ("profile_id", "profile_sha256", "column_registry"):
            scalars[name] = unquote(rest)
    value = lambda k: scalars.get(k) if scalars.get(k) not in ("", "null", "~", None) else None
    keys = lists.get("key", [])
    include = tuple(map(name_bytes, lists["include_columns"])) if "include_columns" in lists else None
    return Profile(include, tuple(map(name_bytes, keys)), tuple(keys), value("profile_id"), value("profile_sha256"), value("column_registry"))


def registry_hash(files: list[tuple[str, bytes]]) -> str:
    h = hashlib.sha256()
    for name, data in files:
        h.update(name.encode() + b"\0" + str(len(data)).encode() + b"\0" + data + b"\xff")
    return f"sha256:{h.hexdigest()}"


def load_registry(profile: Profile, base: Path) -> Registry:
    """Aliases of column names, from every mapping file in name order; the first mapping of a name counts."""
    ref = profile.column_registry
    root = Path(ref) if os.path.isabs(ref) else base / ref

    def refuse(reason: str, file: str | None = None):
        return Refused("E_PROFILE_REGISTRY", {"profile": profile.path, "column_registry": ref, "reason": reason, "file": file})

    if not root.is_dir():
        raise refuse("the registry folder does not exist")
    files: list[tuple[str, bytes]] = []
    aliases: dict[bytes, bytes] = {}
    try:
        head = json.loads((root / "registry.json").read_bytes())
    except (OSError, ValueError) as e:
        raise refuse(str(e), "registry.json") from e
    if not isinstance(head, dict):
        raise refuse("not an object", "registry.json")
    files.append(("registry.json", (root / "registry.json").read_bytes()))
    for p in sorted(root.glob("*.json")):
        if p.name in ("registry.json", "_build.json"):
            continue
        try:
            entries = json.loads(p.read_bytes())
            if not isinstance(entries, list):
                raise ValueError("not an array")
            for e in entries:
                source, target, kind = e["input"], e["canonical_id"], e["canonical_type"]
                if not isinstance(e["rule_id"], str):
                    raise ValueError("rule_id is not text")
                if kind == "column_name":
                    aliases.setdefault(source.encode(), target.encode())
        except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
            raise refuse(str(e), p.name) from e
        files.append((p.name, p.read_bytes()))
    return Registry(ref, str(root.resolve()), registry_hash(files), aliases, tuple(files))


def load_profile(path: str) -> Profile:
    try:
        text = Path(path).read_text()
    except OSError as e:
        raise Refused("E_PROFILE_NOT_FOUND", {"profile_id": path}) from e
    p = replace(parse_profile(text), path=path)
    return replace(p, registry=load_registry(p, Path(path).parent)) if p.column_registry else p


def find_profile(profile_id: str, folder: str | None) -> str:
    """A path wins; else the first frozen profile (id and hash both given) with that id."""
    if os.path.exists(profile_id):
        return profile_id
    root = Path(folder) if folder else profile_folder()
    for p in sorted(root.glob("*.yaml")) if root.is_dir() else []:
        found = parse_profile(p.read_text())
        if found.profile_id == profile_id and found.sha256:
            return str(p)
    raise Refused("E_PROFILE_NOT_FOUND", {"profile_id": profile_id})


def resolve(profile: str | None, profile_id: str | None, folder: str | None) -> Profile | None:
    if profile and profile_id:
        raise Refused("E_AMBIGUOUS_PROFILE", {"profile_path": profile, "profile_id": profile_id})
    if profile_id:
        return load_profile(find_profile(profile_id, folder))
    return load_profile(profile) if profile else None


def render_profile(p: Profile, registry: str | None = None) -> str:
    """The profile as text that parses back to the same; names that need it as hex."""

    def name(b: bytes) -> str:
        t = b.decode("utf-8", "surrogateescape")
        return f'"hex:{b.hex()}"' if "#" in t or not t.isprintable() or t.startswith(("u8:", "hex:")) or '"' in t else f'"{t}"'

    lines = [f"{k}: {v}" for k, v in (("profile_id", p.profile_id), ("profile_sha256", p.sha256), ("column_registry", registry or p.column_registry)) if v]
    if p.include is not None:
        lines += ["include_columns:", *(f"  - {name(b)}" for b in p.include)] if p.include else ["include_columns: []"]
    if p.key:
        lines += ["key:", *(f"  - {name(b)}" for b in p.key)]
    return "\n".join(lines) + "\n"
