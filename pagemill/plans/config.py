"""Configuration: loading, the declarative second version, defaults and checks."""

from __future__ import annotations

import copy
import json
import os

from pagemill.operators.models import BACKENDS, CROPPERS, DECODERS, load_plugin
from pagemill.operators.scheduling import Resize

#: Default, least and greatest of each number, by section.
EXECUTION = {"workers": (4, 1, 128), "page_workers": (None, 1, 128), "box_workers": (1, 1, 128), "document_workers": (2, 1, 32), "max_queued_pages": (2, 1, 256)}
DOCUMENT = {"dpi": (150, 36, 600), "max_pages": (1000, 1, 100_000), "timeout_seconds": (120, 1, 3600), "max_pixels": (40_000_000, 1, 200_000_000), "max_csv_bytes": (16 << 20, 1, 1 << 30)}
MODEL = {"instances": (1, 1, 128), "max_concurrent_requests": (None, 1, 128), "acquire_timeout_ms": (60_000, 1, 3_600_000), "batch_size": (1, 1, 128), "max_batch_wait_ms": (5, 0, 1000), "max_pending_requests": (256, 1, 100_000)}
LAYOUT = {"score_threshold": (0.0, 0, 1), "max_boxes": (2000, 1, 100_000)}
RESIZE = {k: (None, 1, 100_000) for k in ("min_width", "max_width", "min_height", "max_height")} | {k: (None, 1, 200_000_000) for k in ("min_pixels", "max_pixels")} | {"factor": (1, 1, 4096)}
POSTPROCESS = {
    "low_score": {"threshold": (0.3, 0, 1)}, "header_footer": {}, "overlap": {"iou_threshold": (0.5, 0, 1), "score_margin": (0.3, 0, 1)},
    "composite": {"containment_threshold": (0.9, 0, 1), "retain_min_score": (0.7, 0, 1), "max_recovered_boxes": (100, 0, 100_000), "min_inner_text_chars": (4, 0, 100_000)},
    "cross_page_tables": {"edge_margin_ratio": (0.1, 0, 0.5), "x_overlap_threshold": (0.75, 0, 1)},
}
OTHER = {
    "header_footer": {"enabled", "types"}, "overlap": {"enabled", "label_priority"}, "low_score": {"enabled"},
    "composite": {"enabled", "outer_types", "expand_inner_types", "inspect_inner_text", "expand_if_uncovered_text"}, "cross_page_tables": {"enabled", "require_header_match"},
}
#: Fixed values of the optional sections.
ASYNC = {"workers": (128, 1, 256), "max_requests": (256, 1, 1_000_000), "max_bytes": (1 << 28, 1, 1 << 40), "enqueue_timeout_ms": (600_000, 1, 3_600_000)}
ADAPTIVE = {
    "min_concurrency": (None, 1, 128), "initial_concurrency": (None, 1, 128), "window_ms": (5000, 100, 60_000), "min_samples": (8, 1, 10_000), "cooldown_ms": (3000, 0, 60_000), "latency_target_ms": (0, 0, 3_600_000),
    "latency_guard_windows": (None, 1, 100), "token_budget": (32_768, 1, 10**9), "min_token_budget": (None, 1, 10**9), "initial_token_budget": (None, 1, 10**9), "image_pixels_per_token": (784, 1, 10**6), "expected_output_tokens": (512, 1, 10**6),
}
SHARES = ("slow_start_gain", "probe_gain", "probe_step", "backoff_ratio")
VISUAL = {
    "max_num_seqs": (None, 1, 10**6), "max_model_len": (None, 1, 10**9), "max_num_batched_tokens": (None, 1, 10**9), "visual_pixels_per_token": (None, 1, 10**9), "visual_token_overhead": (0, 0, 10**9), "max_visual_tokens": (None, 1, 10**9),
    "prompt_token_overhead": (64, 0, 10**9), "expected_output_tokens": (512, 1, 10**9), "max_wait_ms": (2, 0, 1000), "bucket_scan_limit": (256, 1, 4096), "max_bucket_bypasses": (4, 0, 128),
}
ACTIONS = ("recognize", "skip", "image")
TOP = {"version", "models", "layout", "routes", "execution", "document", "postprocess", "output", "server", "plugins"}


class ConfigError(ValueError):
    pass


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def numbers(section: dict, rules: dict, where: str, others: set[str] = frozenset()) -> dict:
    """section with defaults filled in; unknown keys and numbers out of range are errors."""
    need(isinstance(section, dict), f"{where} must be an object")
    unknown = set(section) - set(rules) - set(others)
    need(not unknown, f"unknown setting {where}.{min(unknown, default='')}")
    out = dict(section)
    for key, (default, low, high) in rules.items():
        value = out.setdefault(key, default)
        if value is not None:
            whole = not isinstance(default, float) and not isinstance(high, float) and high > 1
            need(isinstance(value, int if whole else (int, float)) and not isinstance(value, bool) and low <= value <= high, f"{where}.{key} out of range")
    return out


def normalised(config: dict) -> dict:
    """A second-version configuration as one of the first: executors become models, bindings the executors they name."""
    if config.get("version") != 2:
        return config
    config = copy.deepcopy(config)
    executors, bindings, pipeline = (config.get(k) for k in ("executors", "models", "pipeline"))
    need(bool(executors) and bool(bindings) and isinstance(pipeline, dict), "version 2 needs executors, models and pipeline")
    out = {k: config[k] for k in ("plugins", "execution", "server", "document", "output", "postprocess") if k in config} | {"version": 1, "models": {}}
    for name, e in executors.items():
        need(isinstance(e, dict), f"executor {name} must be an object")
        need(not ("max_inflight" in e and "instances" in e), f"executor {name} sets both max_inflight and instances")
        renamed = {{"max_inflight": "instances", "served_model": "model"}.get(k, k): v for k, v in e.items()}
        renamed["backend"] = {"openai_chat": "chat"}.get(renamed.get("backend"), renamed.get("backend"))
        out["models"][name] = renamed

    def bound(name: str) -> dict:
        b = bindings.get(name)
        need(isinstance(b, dict) and "executor" in b and "adapter" in b, f"binding {name} needs an executor and an adapter")
        need(b["executor"] in out["models"], f"unknown executor {b['executor']}")
        return b

    layout = dict(pipeline["layout"])
    b = bound(layout["model"])
    out["layout"] = {"provider": b["adapter"], "adapter": b["adapter"]} | layout | {"model": b["executor"]}
    out["routes"] = {}
    for kind, route in pipeline["routes"].items():
        need(isinstance(route, dict), f"route {kind} must be an object")
        r = dict(route)
        r["action"] = {"save_crop": "image"}.get(r.get("action"), r.get("action", "recognize"))
        if r.pop("task", None) == "table_recognition":
            r.setdefault("adapter", "table")
        names = r["models"] if "models" in r else [r["model"]] if "model" in r else []
        chosen = [bound(n) for n in names]
        adapters = {c["adapter"] for c in chosen} | ({r["adapter"]} if "adapter" in r else set())
        need("models" not in r or len(adapters) <= 1, f"route {kind}: its candidates have different adapters")
        if chosen:
            r.setdefault("adapter", chosen[0]["adapter"])
            r["binding_ids"] = {c["executor"]: n for c, n in zip(chosen, names, strict=True)}
            r.pop("model", None)
            r["models"] = [c["executor"] for c in chosen]
        out["routes"][kind] = r
    return out


def checked_adaptive(m: dict, out: dict, where: str) -> dict:
    """The section of an adaptive budget: floors, starts and ceilings in order."""
    a = numbers(m, ADAPTIVE, where, {"enabled", "latency_guard_ratio", *SHARES})
    guard = a.get("latency_guard_ratio", 0)
    need(guard == 0 or 1.1 <= guard <= 100, f"{where}.latency_guard_ratio must be 0 or between 1.1 and 100")
    for key in SHARES:
        need(0 < a.get(key, 0.5) < 1, f"{where}.{key} must be between 0 and 1")
    if a.get("enabled"):
        most = out["max_concurrent_requests"]
        low = a["min_concurrency"] or 1
        first = a["initial_concurrency"] or min(4, most)
        need(low <= first <= most, f"{where}: min_concurrency, initial_concurrency and max_concurrent_requests aren't in order")
        budget = a["token_budget"]
        floor = a["min_token_budget"] or max(1, budget * low // most)
        start = a["initial_token_budget"] or max(floor, budget * first // most)
        need(floor <= start <= budget, f"{where}: min_token_budget, initial_token_budget and token_budget aren't in order")
    return a


def checked_visual(m: dict, out: dict, where: str) -> dict:
    """The section of a visual scheduler: increasing lists of integers, and what it needs where it is on."""
    v = numbers(m, VISUAL, where, {"enabled", "bucket_mode", "bucket_edges", "cudagraph_capture_sizes"})
    mode = v.setdefault("bucket_mode", "adaptive")
    need(mode in ("adaptive", "static"), f"{where}.bucket_mode must be adaptive or static")
    for key, required in (("bucket_edges", mode == "static"), ("cudagraph_capture_sizes", True)):
        if key not in v and not (v.get("enabled") and required):
            continue
        some = v.get(key)
        ints = isinstance(some, list) and len(some) <= 128 and all(isinstance(x, int) and not isinstance(x, bool) and 0 < x <= 10**9 for x in some)
        need(ints and all(a < b for a, b in zip(some, some[1:], strict=False)) and (bool(some) or key != "bucket_edges"), f"{where}.{key} must be increasing positive integers")
    if v.get("enabled"):
        for key in ("max_num_seqs", "max_model_len", "max_num_batched_tokens", "visual_pixels_per_token"):
            need(v[key] is not None, f"{where}.{key} is missing")
        need(all(x <= v["max_num_seqs"] for x in v["cudagraph_capture_sizes"]), f"{where}: capture sizes exceed max_num_seqs")
        need(v["max_wait_ms"] < out["acquire_timeout_ms"], f"{where}.max_wait_ms must be under acquire_timeout_ms")
    return v


def validated(config: dict) -> dict:
    """A configuration of either version as a checked first one, with defaults filled in."""
    need(isinstance(config, dict), "the configuration must be an object")
    c = copy.deepcopy(normalised(config))
    need(c.get("version") == 1, "version must be 1 or 2")
    need(not set(c) - TOP, f"unknown section {min(set(c) - TOP, default='')}")
    for p in c.get("plugins", []):
        load_plugin(p)
    need(isinstance(c.get("models"), dict) and bool(c["models"]), "models must be an object that isn't empty")
    for name, m in c["models"].items():
        need(bool(name) and isinstance(m, dict) and m.get("backend") in BACKENDS.entries, f"model {name!r} needs a known backend")
        out = m | numbers({k: m[k] for k in m if k in MODEL}, MODEL, f"models.{name}")
        out["max_concurrent_requests"] = out["max_concurrent_requests"] or out["instances"]
        need(out["max_pending_requests"] >= out["batch_size"], f"models.{name}: max_pending_requests is under batch_size")
        need(out["batch_size"] == 1 or out["max_batch_wait_ms"] < out["acquire_timeout_ms"], f"models.{name}: max_batch_wait_ms must be under acquire_timeout_ms")
        modes = [k for k in ("adaptive_concurrency", "visual_scheduler") if m.get(k, {}).get("enabled")] + ["batching"] * (out["batch_size"] > 1)
        need(len(modes) <= 1, f"models.{name}: {' and '.join(modes)} exclude each other")
        if "adaptive_concurrency" in m:
            out["adaptive_concurrency"] = checked_adaptive(m["adaptive_concurrency"], out, f"models.{name}.adaptive_concurrency")
        if "visual_scheduler" in m:
            out["visual_scheduler"] = checked_visual(m["visual_scheduler"], out, f"models.{name}.visual_scheduler")
        if "input_resize" in m:
            r = numbers(m["input_resize"], RESIZE, f"models.{name}.input_resize")
            need(bool(m["input_resize"]), f"models.{name}.input_resize is empty")
            try:
                low_w, high_w, low_h, high_h = Resize(**{k: v for k, v in r.items() if v is not None}).bounds()
            except ValueError as e:
                raise ConfigError(f"models.{name}.input_resize: {e}") from None
            need(low_w * low_h <= (r["max_pixels"] or 1 << 62) and high_w * high_h >= (r["min_pixels"] or 0), f"models.{name}.input_resize can't be met")
        c["models"][name] = out
    layout = c.get("layout")
    need(isinstance(layout, dict) and layout.get("model") in c["models"], "layout.model must name a model")
    c["layout"] = layout | numbers({k: layout[k] for k in layout if k in LAYOUT}, LAYOUT, "layout")
    need(isinstance(c.get("routes"), dict) and bool(c["routes"]), "routes must be an object that isn't empty")
    for kind, r in c["routes"].items():
        need(isinstance(r, dict) and r.get("action", "recognize") in ACTIONS, f"route {kind} has an unknown action")
        r.setdefault("action", "recognize")
        if r["action"] == "recognize":
            need(("model" in r) != ("models" in r), f"route {kind} needs exactly one of model and models")
            r["models"] = r.pop("models", None) or [r.pop("model")]
            need(bool(r["models"]) and len(set(r["models"])) == len(r["models"]) and all(m in c["models"] for m in r["models"]), f"route {kind} names an unknown model or one twice")
            need(r.get("adapter", "text") in DECODERS.entries, f"route {kind} has an unknown adapter")
        need(r.get("cropper", "bbox") in CROPPERS.entries, f"route {kind} has an unknown cropper")
    execution = numbers(c.get("execution", {}), EXECUTION, "execution", {"on_error", "async_recognition"})
    need(execution.setdefault("on_error", "fail") in ("fail", "record"), "execution.on_error must be fail or record")
    if "async_recognition" in execution:
        execution["async_recognition"] = numbers(execution["async_recognition"], ASYNC, "execution.async_recognition", {"enabled"})
    execution["page_workers"] = execution["page_workers"] or execution["workers"]
    c["execution"] = execution
    c["document"] = numbers(c.get("document", {}), DOCUMENT, "document", {"csv_delimiter", "epub_converter", "ofd_converter"})
    need(c["document"].setdefault("csv_delimiter", ",") in (",", ";", "\t", "|"), "document.csv_delimiter is unknown")
    steps = c.get("postprocess", {})
    need(isinstance(steps, dict) and not set(steps) - set(POSTPROCESS), "unknown postprocess step")
    for name, step in steps.items():
        steps[name] = numbers(step, POSTPROCESS[name], f"postprocess.{name}", OTHER[name])
        need(isinstance(step.get("enabled", False), bool), f"postprocess.{name}.enabled must be true or false")
    c["postprocess"] = steps
    need(c.get("output", {}).get("format", "both") in ("json", "markdown", "both"), "output.format is unknown")
    return c


def load(path: str) -> dict:
    """The checked configuration of a file; relative paths in it are relative to the file."""
    with open(path, encoding="utf-8") as f:
        try:
            c = json.load(f)
        except ValueError as e:
            raise ConfigError(f"the configuration isn't JSON: {e}") from None
    base = os.path.dirname(os.path.abspath(path))
    for m in (c.get("models") or {}).values():
        for key in ("path", "dictionary"):
            if isinstance(m, dict) and isinstance(m.get(key), str):
                m[key] = os.path.join(base, m[key])
    return validated(c)
