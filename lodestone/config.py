"""Settings of an installation, from a YAML or JSON file; every field has a default and its kind is that of the default.

Each section is a frozen dataclass. A file names sections and fields; what it leaves out keeps its default, what no section
knows is reported and ignored. ``LODESTONE_CONFIG`` names the file where none is given; a missing file gives the defaults.
"""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from lodestone.functions.scoring import SearchSettings
from lodestone.sources.embedding import Backend, backend

#: Other names of providers, and the model that each takes where none is named.
PROVIDER_ALIASES = {"huggingface": "sentence_transformers"}
DEFAULT_MODELS = {"hashing": "hashing-64", "sentence_transformers": "intfloat/multilingual-e5-base", "openai_compatible": "text-embedding-3-small", "ollama": "nomic-embed-text"}
#: Models that only one kind of provider has.
SERVICE_MODELS = ["text-embedding-3-small", "text-embedding-3-large", "text-embedding-ada-002"]
LOCAL_MODELS = ["intfloat/multilingual-e5-small", "intfloat/multilingual-e5-base", "intfloat/multilingual-e5-large"]
#: The prefixes that the local models are trained with.
PREFIXES = {"query_prefix": "query: ", "passage_prefix": "passage: "}


@dataclass(frozen=True)
class EmbeddingSettings:
    provider: str = ""
    model: str = ""
    base_url: str = ""
    api_key: str = ""
    api_key_env: str = "OPENAI_API_KEY"
    batch_size: int = 64
    timeout: float = 120.0
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "

    @property
    def key(self) -> str:
        return self.api_key or os.environ.get(self.api_key_env or "-", "")

    def resolved(self) -> EmbeddingSettings:
        """With a provider (named, else by the address, else local) and a model that it has."""
        provider = PROVIDER_ALIASES.get(self.provider, self.provider) or ("openai_compatible" if self.base_url else "sentence_transformers")
        if provider not in DEFAULT_MODELS:
            raise ValueError(f"embedding.provider: unknown {self.provider!r}; there are {', '.join(DEFAULT_MODELS)}")
        foreign = SERVICE_MODELS if provider == "sentence_transformers" else LOCAL_MODELS if provider in ("openai_compatible", "ollama") else ()
        model = self.model.strip()
        if model in foreign:
            warnings.warn(f"{model} isn't a model of {provider}; {DEFAULT_MODELS[provider]} is taken", stacklevel=2)
            model = ""
        return replace(self, provider=provider, model=model or DEFAULT_MODELS[provider])

    def aligned(self, meta: dict) -> EmbeddingSettings:
        """As the index was built: queries must be embedded by its own model, whatever these settings name."""
        own = self.resolved()
        built = PROVIDER_ALIASES.get(meta.get("embedding_provider"), meta.get("embedding_provider")) or own.provider, meta.get("embedding_model") or own.model
        if not meta.get("indexed_count") or not meta.get("embedding_model") or built == (own.provider, own.model):
            return own
        return replace(own, provider=built[0], model=built[1], **(PREFIXES if built[1] in LOCAL_MODELS else {}))

    def backend(self) -> Backend:
        own = self.resolved()
        if own.provider == "hashing":
            return backend("hashing", dimensions=int(own.model.rsplit("-", 1)[-1]))
        options = {"model": own.model, "query_prefix": own.query_prefix, "passage_prefix": own.passage_prefix, "batch": own.batch_size}
        if own.provider == "sentence_transformers":
            return backend(own.provider, **options)
        return backend(own.provider, **options, **({"base_url": own.base_url} if own.base_url else {}), api_key=own.key, timeout=own.timeout)


@dataclass(frozen=True)
class ModuleSettings:
    path: str = ""
    enabled: bool = False


@dataclass(frozen=True)
class Settings:
    platform_version: str = "8.3.27"
    hbk_dir: Path = Path("hbk")
    export_dir: Path = Path("data/export")
    index_dir: Path = Path("data/index")
    benchmark_results_path: Path = Path("config/benchmark_results.json")
    build_vector_index: bool = True
    embedding: EmbeddingSettings = EmbeddingSettings()
    search: SearchSettings = SearchSettings()
    bsp: ModuleSettings = ModuleSettings()
    local_configs: tuple[dict, ...] = field(default=())


def _value(name: str, given, default):
    """``given`` in the kind of ``default``; numbers must be above zero."""
    if isinstance(default, bool):
        words = {"true": True, "yes": True, "1": True, "on": True, "false": False, "no": False, "0": False, "off": False}
        if isinstance(given, bool) or str(given).strip().lower() in words:
            return words[str(given).strip().lower()]
        raise ValueError(f"{name}: neither true nor false: {given!r}")
    if isinstance(default, (int, float)):
        try:
            number = type(default)(given)
        except (TypeError, ValueError):
            raise ValueError(f"{name}: not a number: {given!r}") from None
        if not number > 0:
            raise ValueError(f"{name}: must be above 0")
        return number
    if isinstance(default, Path):
        if not isinstance(given, str) or not given.strip():
            raise ValueError(f"{name}: not a path: {given!r}")
        return Path(given)
    if isinstance(default, tuple):
        rows = given or []
        if not isinstance(rows, list) or any(not isinstance(r, dict) or not all(isinstance(r.get(k), str) and r[k].strip() for k in ("path", "label")) for r in rows):
            raise ValueError(f"{name}: a list of path and label is needed")
        return tuple({"path": r["path"], "label": r["label"]} for r in rows)
    if given is not None and not isinstance(given, str):
        raise ValueError(f"{name}: not a text: {given!r}")
    return given or ""


def _section(kind, given, where: str = ""):
    if given is not None and not isinstance(given, dict):
        raise ValueError(f"{where or 'the file'}: fields are needed, not {type(given).__name__}")
    defaults, given, found = kind(), given or {}, {}
    for name in given.keys() - {f.name for f in fields(kind)}:
        warnings.warn(f"unknown setting {where}{name}", stacklevel=2)
    for f in fields(kind):
        if f.name in given:
            default = getattr(defaults, f.name)
            nested = hasattr(default, "__dataclass_fields__")
            found[f.name] = _section(type(default), given[f.name], f"{where}{f.name}.") if nested else _value(where + f.name, given[f.name], default)
    return kind(**found)


def load(path: str | None = None) -> Settings:
    """The settings of a file. Paths in it are relative to its folder."""
    path = path or os.environ.get("LODESTONE_CONFIG", "")
    if not path or not Path(path).exists():
        return Settings()
    content = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        raw = json.loads(content)
    else:
        import yaml

        raw = yaml.safe_load(content)
    found = _section(Settings, raw)
    base = Path(path).resolve().parent
    return replace(found, **{f.name: base / getattr(found, f.name) for f in fields(found) if isinstance(getattr(found, f.name), Path)})


def update(path: str, section: str, values: dict) -> Settings:
    """Changes a section of the file: the new text is checked first and takes the old one's place at once, or not at all."""
    target = Path(path)
    import yaml

    raw = (yaml.safe_load(target.read_text(encoding="utf-8")) if target.exists() else None) or {}
    raw[section] = (raw.get(section) or {}) | values
    fresh = target.with_name(target.name + ".new" + target.suffix)
    text = json.dumps(raw, ensure_ascii=False, indent=1) if path.endswith(".json") else yaml.safe_dump(raw, allow_unicode=True, sort_keys=False)
    with open(fresh, "w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    try:
        load(str(fresh))
        os.replace(fresh, target)
    finally:
        fresh.unlink(missing_ok=True)
    return load(path)
