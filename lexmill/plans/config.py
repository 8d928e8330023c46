"""Settings: search, load, imports, merging, overrides, language settings."""

from __future__ import annotations

import json
import os
import re
import tomllib
from typing import Any

from lexmill.plans import globs, patterns
from lexmill.sources.files import LANGUAGES, locale_matches

NATIVE = [".spelling/config.toml", "spelling.toml"]
_STEMS = [".cspell", "cspell", ".cSpell", "cSpell", "cspell.config", ".cspell.config"]
NAMES = [*NATIVE, *(f"{s}{e}" for s in _STEMS for e in (".json", ".jsonc", ".json5", ".yaml", ".yml", ".toml")), "package.json"]
LISTS = ["words", "userWords", "ignoreWords", "flagWords", "suggestWords", "dictionaryDefinitions", "ignoreRegExpList", "includeRegExpList", "patterns", "ignorePaths", "overrides", "languageSettings", "import"]
UNIQUE = ["dictionaries", "noSuggestDictionaries"]
DEFAULTS = {"language": "en", "allowCompoundWords": False, "maxNumberOfProblems": 10_000, "minWordLength": 4, "maxDuplicateProblems": 5, "minRandomLength": 40}

#: Which dictionaries files of a language add
_LANGUAGE_DICTS = [
    (["javascript", "javascriptreact"], ["node", "npm", "typescript"]),
    (["mdx", "typescript", "typescriptreact"], ["node", "npm", "typescript"]),
    (["javascriptreact", "mdx", "typescriptreact"], ["css", "fonts", "html", "html-symbol-entities"]),
    (["asciidoc", "markdown"], ["html", "html-symbol-entities", "npm"]),
    (["handlebars", "html", "jade", "php", "pug"], ["css", "fonts", "html", "html-symbol-entities", "npm", "typescript"]),
    (["json", "jsonc"], ["node", "npm"]),
    (["php"], ["php"]),
    (["css", "less", "scss"], ["css", "fonts"]),
]


def language_defaults() -> list[dict]:
    """C12."""
    link = r"[-\w.`'\"*&;#@ ]+"
    out: list[dict] = [{"languageId": ids, "dictionaries": dicts} for ids, dicts in _LANGUAGE_DICTS]
    out += [{"languageId": [x], "enabled": False} for x in ("map", "image", "binary")]
    out.append({"languageId": ["html", "markdown", "mdx"], "ignoreRegExpList": ["HTML-symbol-entity"], "patterns": [{"name": "HTML-symbol-entity", "pattern": "&[a-z]+;"}]})
    out.append({"languageId": ["html"], "ignoreRegExpList": ["href"], "patterns": [{"name": "href", "pattern": r'\bhref\s*=\s*"[^"]*"'}]})
    marks = {"reference": rf"\]\[{link}\]", "footer": rf"\[{link}\]:( [^\s]*)?", "link": r"\]\([^)\s]+", "anchor": r'<a\s+id="[^"\s]+'}
    out.append({"languageId": ["markdown"], "ignoreRegExpList": [f"markdown-{k}" for k in marks], "patterns": [{"name": f"markdown-{k}", "pattern": v} for k, v in marks.items()]})
    return out


def pattern_defaults() -> list[dict]:
    """C11: names that settings may use for the built-in kinds of text to skip."""
    hexa = "[0-9a-f]"
    own = {
        "CommitHash": rf"/\b(?:0x)?{hexa}{{7,}}\b/gi", "CommitHashLink": rf"/\[{hexa}{{7,}}\]/gi", "CStyleHexValue": r"/\b0x[0-9a-f_]+n?\b/gi", "CSSHexValue": rf"/#{hexa}{{3,8}}\b/gi",
        "Urls": r'/(?:https?|ftp):\/\/[^\s"]+/gi', "EscapeCharacters": r"/\\(?:[anrvtbf]|[xu][a-f0-9]+)/gi", "Email": r"/<?\b[\w.\-+]{1,128}@\w{1,63}(\.\w{1,63}){1,4}\b>?/gi", "SHA": r"/\bsha\d+-[a-z0-9+\/]{25,}={0,3}/gi",
        "UnicodeRef": rf"/\bU\+{hexa}{{4,5}}(?:-{hexa}{{4,5}})?/gi", "UUID": r"/\b[0-9a-fx]{8}(?:-[0-9a-fx]{4}){3}-[0-9a-fx]{12}\b/gi", "href": r'/\bhref\s*=\s*".*?"/gi', "PhpHereDoc": r"/<<<['\"]?(\w+)['\"]?[\s\S]+?^\1;/gm", "Everything": ".*",
    }
    return [{"name": k, "pattern": v} for k, v in own.items()]


def without_comments(text: str) -> str:
    """C4: JSON with comments, single quotes, bare keys and trailing commas, as plain JSON."""
    out, k = [], 0
    while k < len(text):
        c = text[k]
        if c in "\"'":
            m = re.compile(rf"{c}(?:\\.|[^\\{c}])*{c}", re.S).match(text, k)
            s = m[0] if m else text[k:]
            k += len(s)
            out.append(s if c == '"' else json.dumps(s[1:-1].replace("\\'", "'")))
        elif text.startswith("//", k):
            k = (text.find("\n", k) + 1 or len(text) + 1) - 1
        elif text.startswith("/*", k):
            k = (text.find("*/", k) + 2) if "*/" in text[k:] else len(text)
        else:
            out.append(c)
            k += 1
    joined = "".join(out)
    parts = re.split(r'("(?:\\.|[^"\\])*")', joined)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*)(\s*:)", r'\1"\2"\3', parts[i])
    joined = "".join(parts)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], joined)


def parse_yaml(text: str) -> Any:
    """C4: the part of YAML that settings use: nested maps and lists by indent, flow lists, scalars, comments."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]

    def scalar(v: str) -> Any:
        v = re.sub(r"\s+#.*$", "", v).strip() if not v.startswith(("'", '"')) else v
        if v.startswith("[") or v.startswith("{"):
            try:
                return json.loads(without_comments(v))
            except ValueError:
                return [scalar(x) for x in v.strip("[]").split(",") if x.strip()]
        if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"":
            return v[1:-1].replace("''", "'") if v[0] == "'" else json.loads(v)
        low = v.lower()
        if low in ("true", "false", "null", "~", ""):
            return {"true": True, "false": False}.get(low)
        return int(v) if re.fullmatch(r"-?\d+", v) else v

    def block(k: int, indent: int) -> tuple[Any, int]:
        if rows[k][1].startswith("- ") or rows[k][1] == "-":
            items = []
            while k < len(rows) and rows[k][0] == indent and rows[k][1].startswith("-"):
                body = rows[k][1][1:].strip()
                if re.match(r"[\w.$-]+:(?:\s|$)", body):
                    rows[k] = (indent + 2, body)
                    item, k = block(k, indent + 2)
                elif body:
                    item, k = scalar(body), k + 1
                else:
                    item, k = block(k + 1, rows[k + 1][0])
                items.append(item)
            return items, k
        out: dict[str, Any] = {}
        while k < len(rows) and rows[k][0] == indent and not rows[k][1].startswith("- "):
            key, _, value = rows[k][1].partition(":")
            key = key.strip().strip("'\"")
            if value.strip():
                out[key], k = scalar(value.strip()), k + 1
            elif k + 1 < len(rows) and (rows[k + 1][0] > indent or rows[k + 1][0] == indent and rows[k + 1][1].startswith("-")):
                out[key], k = block(k + 1, rows[k + 1][0])
            else:
                out[key], k = None, k + 1
        return out, k

    return block(0, rows[0][0])[0] if rows else {}


def parse(path: str, content: str) -> dict:
    """C4: settings of a file, by its extension; of package.json its section."""
    name = os.path.basename(path)
    if name.endswith((".yaml", ".yml")):
        return parse_yaml(content) or {}
    if name.endswith(".toml"):
        return native_settings(tomllib.loads(content), os.path.dirname(path)) if path.endswith(tuple(NATIVE)) else tomllib.loads(content)
    try:
        data = json.loads(content)
    except ValueError:
        data = json.loads(without_comments(content))
    return data.get("cspell", {}) if name == "package.json" else data


def native_settings(data: dict, folder: str) -> dict:
    """A native file keeps words in side files: lists named by it, and ``dict/*.txt`` beside it."""
    out = {k: v for k, v in data.items() if k not in ("word_files", "ignore_files", "flag_files")}
    for key, to in (("word_files", "words"), ("ignore_files", "ignoreWords"), ("flag_files", "flagWords")):
        for f in data.get(key, []):
            out[to] = [*out.get(to, []), *read_words(os.path.join(folder, f))]
    extra = os.path.join(folder, "dict")
    if os.path.isdir(extra):
        for f in sorted(os.listdir(extra)):
            if f.endswith(".txt"):
                out["words"] = [*out.get("words", []), *read_words(os.path.join(extra, f))]
    return out


def read_words(path: str) -> list[str]:
    """S29, on the driver."""
    try:
        with open(path, encoding="utf-8") as f:
            return [w for x in f if (w := x.strip()) and not w.startswith("#")]
    except FileNotFoundError:
        return []


def find(start: str, stop: tuple[str, ...] = ()) -> str | None:
    """The first settings file in a folder or those above it; the native kind comes first."""
    at = os.path.abspath(start)
    while True:
        for n in NAMES:
            p = os.path.join(at, n)
            if os.path.isfile(p) and (n != "package.json" or parse(p, _text(p))):
                return p
        up = os.path.dirname(at)
        if up == at or at in stop:
            return None
        at = up


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def merge(base: dict, over: dict) -> dict:
    """Scalars of ``over`` win, lists follow each other, dictionaries appear once in any case."""
    out = dict(base)
    for k, v in over.items():
        if k in UNIQUE:
            have = {x.lower() for x in base.get(k, [])}
            out[k] = [*base.get(k, []), *(x for x in v if x.lower() not in have)]
        elif k in LISTS:
            as_list = lambda x: x if isinstance(x, list) else [x]
            out[k] = [*as_list(base.get(k, [])), *as_list(v)]
        elif k == "repMap":
            out[k] = v or base.get(k, [])
        elif v is not None:
            out[k] = v
    return out


def load(path: str, seen: set[str] | None = None) -> dict:
    """Settings with their imports below them; an import seen before is left out."""
    seen = seen if seen is not None else set()
    path = os.path.abspath(path)
    if path in seen:
        return {}
    seen.add(path)
    own = parse(path, _text(path))
    imports = own.pop("import", [])
    out: dict = {}
    for i in [imports] if isinstance(imports, str) else imports:
        target = i if os.path.isabs(i) else os.path.join(os.path.dirname(path), i)
        if os.path.isfile(target):
            out = merge(out, load(target, seen))
    root = os.path.dirname(path)
    for d in own.get("dictionaryDefinitions", []):
        if d.get("path") and not os.path.isabs(d["path"]):
            d["path"] = os.path.join(root, d["path"])
    return merge(out, own)


def language_ids(path: str, settings: dict) -> list[str]:
    """``*``, then those of the settings or else those of the name."""
    given = settings.get("languageId")
    if given:
        own = [x.strip() for x in re.split("[,|;]", given) if x.strip()]
    else:
        name = os.path.basename(path)
        own = LANGUAGES.get(name.rsplit(".", 1)[-1].lower() if "." in name[1:] else "", [])
    return list(dict.fromkeys(["*", *own]))


def id_matches(wanted: list[str], i: str) -> bool:
    """F39 for one id."""
    low, i = [w.lower() for w in wanted], i.lower()
    return not low or i in low or f"!{i}" not in low and all(w.startswith("!") for w in low)


def with_overrides(settings: dict, path: str) -> dict:
    """The overrides whose globs match a path, in order."""
    out = {k: v for k, v in settings.items() if k != "overrides"}
    for o in settings.get("overrides", []):
        names = o.get("filename", [])
        names = [n if isinstance(n, str) else n["glob"] for n in ([names] if isinstance(names, (str, dict)) else names)]
        yes = [r for n in names if not n.startswith("!") for r in globs.nested(n)]
        no = [r for n in names if n.startswith("!") for r in globs.nested(n[1:])]
        hit = lambda rs: any(re.match(globs.glob_regex(r, False), path) for r in rs)
        if hit(yes) and not hit(no):
            out = merge(out, {k: v for k, v in o.items() if k != "filename"})
    return out


def with_languages(settings: dict, path: str) -> dict:
    """The language settings that match a path's languages and the locale, in order."""
    out = {k: v for k, v in settings.items() if k != "languageSettings"}
    ids = language_ids(path, settings)
    for ls in settings.get("languageSettings", []):
        wanted = ls.get("languageId", [])
        wanted = [x.strip() for x in wanted.split(",")] if isinstance(wanted, str) else wanted
        if any(id_matches(wanted, i) for i in ids) and locale_matches(ls.get("locale"), settings.get("language") or "en"):
            out = merge(out, {k: v for k, v in ls.items() if k not in ("languageId", "locale")})
    return out


def for_path(settings: dict, path: str) -> dict:
    """Effective settings of one path; ``enabled`` false takes it out."""
    return with_languages(with_overrides(settings, path), path)


def with_defaults(settings: dict, dictionaries: list[str] = ()) -> dict:
    """Defaults below the settings; ``!name`` takes a default dictionary out."""
    out = merge(merge(DEFAULTS, {"languageSettings": language_defaults(), "patterns": pattern_defaults(), "dictionaries": list(dictionaries)}), settings)
    barred = {d[1:].lower() for d in out.get("dictionaries", []) if d.startswith("!")}
    out["dictionaries"] = [d for d in out.get("dictionaries", []) if not d.startswith("!") and d.lower() not in barred]
    return out


def active_dictionaries(settings: dict, named: list[str], disabled: list[str] = (), enabled: list[str] = ()) -> list[str]:
    """Those asked for, or all if none is; switched off, then on, by hand."""
    asked = {d.lower() for d in settings.get("dictionaries", [])}
    on = [n for n in named if not asked or n.lower() in asked]
    off, back = {d.lower() for d in disabled}, {d.lower() for d in enabled}
    return [n for n in named if n.lower() in back or n in on and n.lower() not in off]


def template(kind: str = "json", words: list[str] = (), imports: list[str] = (), locale: str = "en") -> str:
    """A new settings file."""
    data = {"version": "0.2", "language": locale, "words": list(words), "import": list(imports), "ignorePaths": []}
    if kind in ("json", "jsonc"):
        return json.dumps(data, indent=2) + "\n"
    lines = [f"{k}: {json.dumps(v)}" if not isinstance(v, list) or not v else f"{k}:\n" + "\n".join(f"  - {json.dumps(x)}" for x in v) for k, v in data.items()]
    return "\n".join(lines) + "\n"


def link(settings: dict, add: list[str] = (), remove: list[str] = ()) -> dict:
    """The global list of imports with some added or removed."""
    have = settings.get("import", [])
    have = [have] if isinstance(have, str) else have
    return settings | {"import": [*(x for x in have if x not in remove), *(x for x in add if x not in have)]}


def migrated(settings: dict) -> tuple[dict, dict[str, list[str]]]:
    """(settings without word lists, side files): words, ignored and flagged words move to files of their own."""
    moved = {"words": ("word_files", "dict/words.txt"), "ignoreWords": ("ignore_files", "dict/ignore.txt"), "flagWords": ("flag_files", "dict/flag.txt")}
    out, files = dict(settings), {}
    for k, (key, file) in moved.items():
        if out.get(k):
            files[file] = sorted(dict.fromkeys(out.pop(k)), key=str.lower)
            out[key] = [file]
    return out, files


def skip_lists(settings: dict) -> tuple[list[str], list[str], set[str]]:
    """X17 for resolved settings."""
    return patterns.resolve(settings.get("ignoreRegExpList", []), {p["name"]: p["pattern"] for p in settings.get("patterns", [])})
