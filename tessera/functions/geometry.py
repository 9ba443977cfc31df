"""Model geometry as Columns over rows of settings (S25, A25, A27, A32, C31, C32): a row per model, however many there are.

What follows from the settings is stated as SQL expressions, one per name, so that sizes of a whole sweep of models are one
projection, and inventories of tensors one explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. Defaults of the settings:
DEFAULTS = {
    "vocab_size": 8192, "d_model": 512, "num_heads": 8, "num_kv_heads": 4, "num_layers": 27, "max_seq_len": 2048, "lanes": 4, "sites": 2, "orders": 2, "slots": 8192,
    "retrieval_dim": 128, "retrieval_probes": 4, "confidence_probes": 8, "kv_window": 256,
}
# Fixed values. The named settings, by what differs from the defaults:
PRESETS = {
    "base": {},
    "wide": {"d_model": 768, "num_heads": 12, "num_kv_heads": 6},
    "tiny": {"d_model": 128, "num_heads": 4, "num_kv_heads": 2, "num_layers": 2, "sites": 1, "slots": 256, "lanes": 2, "max_seq_len": 256, "kv_window": 128},
}
# Fixed values. Bytes of a session: for keys and values, and for what doesn't depend on the settings; sizes of groups.
KV_BUDGET, KV_GROUP, KV_WINDOW_MIN, SUB_DIM, TAPS = 11 * 1024 * 1024 + 512 * 1024, 32, 160, 128, 4
ARENA, LOADER, TRIES, TOKENIZER = 2_998_272, 1_343_488, 918_016, 412_800

#: What follows from the settings, each from those before it.
DERIVED = {
    "head_dim": "d_model div num_heads",
    "kv_dim": "num_kv_heads * head_dim",
    "wide": "lanes * d_model",
    "hadamard": "cast(pow(2, ceil(log2(d_model))) AS bigint)",
    "tables": f"orders * greatest(1, d_model div (orders * {SUB_DIM}))",
    "kv_bytes": f"num_layers * 2 * (kv_dim + kv_dim div {KV_GROUP} * 4) + sites * (d_model + d_model div {KV_GROUP} * 4)",
    "budget_window": f"greatest({KV_WINDOW_MIN}, least(({KV_BUDGET} div kv_bytes) div {KV_GROUP} * {KV_GROUP}, max_seq_len))",
    "live_window": "least(budget_window, if(kv_window > 0, kv_window, budget_window))",
    "block": "3 * d_model * d_model + 2 * d_model * kv_dim + 2 * head_dim + 3 * d_model + 1 + 3 * hadamard",
}
#: Parameters by component; the last is there in training only.
COMPONENTS = {
    "embedding": "vocab_size * d_model",
    "blocks": "num_layers * block",
    "routers": "num_layers * (wide * lanes * (2 + lanes) + 2 * lanes + lanes * lanes + 3)",
    "memory": f"sites * (tables * slots * (d_model div tables) + 2 * d_model * d_model + {TAPS} * d_model)",
    "retrieval": "retrieval_probes * d_model * (1 + retrieval_dim) + 1",
    "confidence": "2 * confidence_probes * d_model + 1",
    "final_norm": "d_model",
    "training_only": "2 * d_model * d_model + block + 2 * d_model",
}
#: Bytes of a live session by part, beside its ``weights`` and ``tools``.
SESSION = {
    "weights": "weights", "prefill scratch": "live_window * wide * 4 + num_heads * live_window * live_window * 4", "KV cache": "live_window * kv_bytes", "allocator arena": str(ARENA),
    "loader and constants": str(LOADER), "tries": str(TRIES), "tokenizer": str(TOKENIZER), "retrieval index": "tools * retrieval_dim * 2", "logits": "vocab_size * 4",
}
#: The tensors of each component, by their sizes; what is repeated has its count in front.
INVENTORY = {
    "embedding": "vocab_size, d_model",
    **{f"block.{k}": "num_layers, d_model, d_model" for k in ("attn.q_proj", "attn.gate_proj", "attn.out_proj")},
    **{f"block.{k}": "num_layers, d_model, kv_dim" for k in ("attn.k_proj", "attn.v_proj")},
    **{f"block.{k}": "num_layers, head_dim" for k in ("attn.q_norm", "attn.k_norm")},
    **{f"block.{k}": "num_layers, d_model" for k in ("attn.pre_norm", "attn.post_norm", "mix.norm")},
    "block.attn.gate": "num_layers",
    **{f"block.{k}": "num_layers, hadamard" for k in ("mix.first", "mix.second", "mix.third")},
    **{f"router.{k}": "num_layers, wide, lanes" for k in ("pre", "post")},
    "router.res": "num_layers, wide, lanes * lanes",
    **{f"router.{k}": "num_layers, lanes" for k in ("pre_bias", "post_bias")},
    "router.res_bias": "num_layers, lanes, lanes",
    **{f"router.{k}": "num_layers" for k in ("pre_scale", "post_scale", "res_scale")},
    "memory.table": "sites, tables, slots, d_model div tables",
    **{f"memory.{k}": "sites, d_model, d_model" for k in ("k_proj", "v_proj")},
    "memory.taps": f"sites, {TAPS}, d_model",
    "retrieval.probe": "retrieval_probes, d_model",
    "retrieval.proj": "retrieval_probes, d_model, retrieval_dim",
    "retrieval.temp": "",
    **{f"confidence.{k}": "confidence_probes, d_model" for k in ("probe", "gate")},
    "confidence.bias": "",
    "final_norm": "d_model",
}


def with_settings(df: DataFrame) -> DataFrame:
    """``df`` with every setting as a long, the default where it has none or a null, and what follows from them.

    A model width that its heads don't divide, or heads that theirs don't, fail the row's job."""
    have = set(df.columns)
    df = df.withColumns({k: F.coalesce(F.col(k).cast("long"), F.lit(v).cast("long")) if k in have else F.lit(v).cast("long") for k, v in DEFAULTS.items()})
    wrong = F.raise_error(F.lit("d_model must divide by num_heads, and num_heads by num_kv_heads")).cast("long")
    df = df.withColumn("num_heads", F.when((F.col("d_model") % F.col("num_heads") != 0) | (F.col("num_heads") % F.col("num_kv_heads") != 0), wrong).otherwise(F.col("num_heads")))
    for name, rule in DERIVED.items():
        df = df.withColumn(name, F.expr(rule).cast("long"))
    return df


def yaml_settings(text: Column) -> Column:
    """The settings of a flat YAML text, ``name: value`` lines, as a map; a list in brackets stands for its length."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*(#.*)?$"))
    value = lambda x: F.btrim(F.regexp_replace(F.regexp_extract(x, r"^\s*\w+\s*:(.*)$", 1), r"(^|\s)#.*$", ""))
    counted = lambda v: F.when(v.rlike(r"^\[.*\]$"), F.regexp_count(v, F.lit(r"[^\[\],\s][^,\]]*")).cast("string")).otherwise(F.regexp_replace(v, "^(['\"])(.*)\\1$", "$2"))
    name = lambda x: F.when(x.rlike(r"^\s*\w+\s*:"), F.regexp_extract(x, r"^\s*(\w+)\s*:", 1)).otherwise(F.raise_error(F.concat(x, F.lit(" is not name: value"))))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(name(x), counted(value(x)))))


def of_yaml(df: DataFrame, text: str) -> DataFrame:
    """``with_settings`` of a column of YAML texts; unknown settings are left out."""
    said = df.withColumn(text, yaml_settings(F.col(text)))
    return with_settings(said.withColumns({k: F.try_element_at(F.col(text), F.lit(k)).try_cast("long") for k in DEFAULTS}).drop(text))


def of_preset(df: DataFrame, name: str) -> DataFrame:
    """``with_settings`` of named settings; columns that ``df`` has go before the preset's. An unknown name fails."""
    known = F.col(name).isin(*PRESETS)
    df = df.withColumn(name, F.when(known, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("no preset "), F.col(name)))))
    own = {k: [(n, p[k]) for n, p in PRESETS.items() if k in p] for k in DEFAULTS}
    picked = {}
    for k, pairs in own.items():
        v = F.lit(None).cast("long")
        for n, x in pairs:
            v = F.when(F.col(name) == n, F.lit(x).cast("long")).otherwise(v)
        picked[k] = F.coalesce(F.col(k).cast("long"), v) if k in df.columns else v
    return with_settings(df.withColumns(picked))


def _rows(df: DataFrame, keep: list[str], name: str, value: str, rules: dict[str, str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias(name), F.expr(rule).cast("long").alias(value)) for n, rule in rules.items()])
    return df.select(*keep, F.inline(pairs))


def param_count(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., component, params) for rows of ``with_settings``."""
    return _rows(df, keep, "component", "params", COMPONENTS)


def session_budget(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., part, bytes) for rows of ``with_settings`` with ``weights`` and ``tools``."""
    return _rows(df, keep, "part", "bytes", SESSION)


def _component(tensor: str) -> str:
    return {"block": "blocks", "router": "routers"}.get(tensor.split(".")[0], tensor.split(".")[0])


def _shape(sizes: str) -> Column:
    return (F.expr(f"array({sizes})") if sizes else F.expr("array()")).cast("array<long>")


def tensors(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., component, name, shape) of every tensor that ships, stacked by layer or site."""
    all_ = F.array(*[F.struct(F.lit(_component(n)).alias("component"), F.lit(n).alias("name"), _shape(s).alias("shape")) for n, s in INVENTORY.items()])
    return df.select(*keep, F.inline(all_))


def shipped(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., component, params): the sizes of ``tensors`` by component, added up within the row, where they all are."""
    by = {}
    for n, s in INVENTORY.items():
        by.setdefault(_component(n), []).append(size_of(_shape(s)))
    add = lambda sizes: F.aggregate(F.array_compact(F.array(*sizes)), F.lit(None).cast("long"), lambda n, x: F.coalesce(n, F.lit(0)) + x)
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("component"), add(sizes).alias("params")) for c, sizes in by.items()])))


def size_of(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda n, x: n * x)


def learning_rate(step: Column, peak: float, warmup: int, total: int, floor: float = 0.01) -> Column:
    """Linear warm-up, then a cosine to ``floor`` of the peak."""
    done = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    cosine = peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(done * F.pi())))
    return F.when(step < warmup, peak * step / F.lit(float(max(1, warmup)))).otherwise(cosine)
