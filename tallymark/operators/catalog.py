"""Model catalog rows: configuration, not data."""

from __future__ import annotations

from typing import NamedTuple


class ModelSpec(NamedTuple):
    name: str
    path: str
    load_in_4bit: bool = False
    load_in_8bit: bool = False


MODELS = (
    ModelSpec("m0", "meta-llama/Llama-2-13b-chat"),
    ModelSpec("m1", "meta-llama/Llama-3.1-8B-Instruct", load_in_8bit=True),
    ModelSpec("m2", "meta-llama/Llama-3.2-3B-Instruct"),
    ModelSpec("m3", "Qwen/Qwen2.5-14B-Instruct", load_in_4bit=True),
    ModelSpec("m4", "Qwen/Qwen1.5-72B-Chat"),
    ModelSpec("m5", "mistralai/Mistral-7B-v0.3"),
    ModelSpec("m6", "google/gemma-chat"),
    ModelSpec("m7", "meta-llama/Meta-Llama-3-70B", load_in_4bit=True),
)
