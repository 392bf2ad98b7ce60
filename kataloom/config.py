"""Settings: defaults, a YAML file over them, then the environment and values from the caller."""

from __future__ import annotations

import copy
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

#: The names and defaults of every setting.
DEFAULTS: dict[str, Any] = {
    "project": {"name": "kataloom", "database": "data"},
    "collection": {
        "default_limit": 500,
        "default_source": "file",
        "youtube": {
            "daily_search_quota": 100, "max_comment_pages_per_selected_video": 10, "max_search_calls_per_run": 10, "max_videos_per_keyword": 25,
            "max_comment_pages_per_video": 2, "comments_per_page": 100, "order": "relevance", "region_code": "ID", "relevance_language": "id",
            "published_after": None, "use_search_terms": False, "include_replies": True, "request_timeout": 30, "retry_attempts": 3, "retry_backoff": 2.0,
        },
        "privacy": {"store_author_id": False},
    },
    "cleaning": {
        "unicode_form": "NFKC", "lowercase": True, "url_placeholder": "", "mention_placeholder": "", "keep_hashtag_text": True, "normalize_slang": True,
        "slang_file": None, "stopword_file": None, "use_sastrawi_stopwords": True, "max_repeated_chars": 2, "min_token_length": 2,
        "filter_stopwords": True, "use_stemming": False, "batch_size": 500, "drop_numeric": True,
    },
    "dedup": {"enabled": True, "near_duplicate": True, "simhash_bits": 64, "shingle_size": 3, "hamming_threshold": 3, "bands": 4},
    "spam": {
        "enabled": True, "max_urls": 2, "max_mentions": 5, "max_hashtags": 5, "min_tokens_after_clean": 2, "min_token_diversity": 0.35,
        "max_char_run": 10, "detect_phone_numbers": True, "copypasta_min_authors": 5,
    },
    "analysis": {
        "top_n": 100, "ngram": {"sizes": [1, 2, 3], "min_frequency": 3}, "tfidf": {"sublinear_tf": True, "smooth_idf": True},
        "cooccurrence": {"window": 5, "min_pair_frequency": 3, "metric": "pmi"},
    },
    "discovery": {
        "min_doc_frequency": 3, "min_term_length": 3, "max_candidates": 50, "weights": {"frequency": 0.25, "tfidf": 0.35, "cooccurrence": 0.30, "ngram": 0.10},
        "ngram_bonus": 1.0, "respect_previous_rejections": True,
    },
    "lexicon": {
        "user_agent": "kataloom", "request_delay": 2.0, "request_timeout": 30, "retry_attempts": 3, "retry_backoff": 2.0, "respect_robots_txt": True,
        "refetch_after_days": 30, "max_entries_per_run": 200, "exclude_categories": ["Nama Orang"],
        "sources": {"kbbj": {"enabled": True, "base_url": "https://kbbj.web.id", "sitemap": "https://kbbj.web.id/sitemap-words.xml"}},
    },
    "ui": {"color": True, "effects": True, "line_delay": 0.02, "boot_delay": 0.6, "tips": True, "history_size": 200},
    "logging": {"level": "INFO", "file": "data/kataloom.log"},
}
#: Variables of the environment that overrule a setting, and the one that holds the platform's key (which no file of settings may hold).
ENVIRONMENT = {"KATALOOM_DATABASE": "project.database", "KATALOOM_LOG_LEVEL": "logging.level"}
API_KEY = "YOUTUBE_API_KEY"
#: Sections whose keys are the user's own.
OPEN = ("lexicon.sources",)


def unknown_settings(values: Mapping[str, Any], known: Mapping[str, Any] = DEFAULTS, at: str = "") -> list[str]:
    """The dotted names in ``values`` that are no settings."""
    out = []
    for key, value in values.items():
        name = f"{at}{key}"
        if key not in known:
            out.append(name)
        elif isinstance(value, Mapping) and isinstance(known[key], Mapping) and name not in OPEN:
            out += unknown_settings(value, known[key], name + ".")
    return out


def merged(base: Mapping[str, Any], over: Mapping[str, Any] | None) -> dict[str, Any]:
    """``base`` with ``over`` laid on it, mapping by mapping; neither argument is changed."""
    out = copy.deepcopy(dict(base))
    for key, value in (over or {}).items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else copy.deepcopy(value)
    return out


def read_env_file(path: str) -> dict[str, str]:
    """NAME=value lines of a file; blank lines and # comments are skipped, outer quotes dropped. A missing file has none."""
    out: dict[str, str] = {}
    if not Path(path).is_file():
        return out
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, eq, value = line.strip().partition("=")
        if eq and name and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("'\"")
    return out


class Config:
    """Settings with dotted lookup; ``Config()`` holds the defaults. Unknown names are refused."""

    def __init__(self, values: Mapping[str, Any] | None = None, api_key: str | None = None) -> None:
        if wrong := unknown_settings(values or {}):
            raise ValueError(f"unknown settings: {', '.join(wrong)}")
        self.values, self.api_key = merged(DEFAULTS, values), api_key

    @classmethod
    def load(cls, path: str | None = None, overrides: Mapping[str, Any] | None = None, *, env_file: str = ".env", environ: Mapping[str, str] | None = None) -> Config:
        """From a YAML file (if PyYAML is there), the environment over it, and dotted ``overrides`` last.

        What ``env_file`` says holds where the environment itself says nothing.
        """
        values: dict[str, Any] = {}
        if path is not None:
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("reading a YAML file needs PyYAML") from e
            values = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
            if not isinstance(values, Mapping):
                raise ValueError(f"{path} is no mapping of settings")
            values = copy.deepcopy(dict(values))
        env = read_env_file(env_file) | dict(os.environ if environ is None else environ)
        dotted = {setting: env[name] for name, setting in ENVIRONMENT.items() if env.get(name)}
        for name, value in (dotted | dict(overrides or {})).items():
            at = values
            *parents, last = name.split(".")
            for part in parents:
                at = at.setdefault(part, {})
            at[last] = value
        return cls(values, env.get(API_KEY, "").strip() or None)

    def get(self, dotted: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in dotted.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def section(self, name: str) -> dict[str, Any]:
        got = self.get(name)
        return copy.deepcopy(dict(got)) if isinstance(got, Mapping) else {}
