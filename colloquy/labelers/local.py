"""A candidate model inside the executor: loaded once per task, by either of two engines that are imported only then."""

from __future__ import annotations

from collections.abc import Callable

from colloquy.labelers.base import CANDIDATE_SYSTEM, ModelLabeler, Reply, Request

#: (system, prompt) to (text, input tokens, output tokens).
Generate = Callable[[str, str], tuple[str, int, int]]


def _messages(system: str, prompt: str) -> list[dict]:
    return [{"role": "system", "content": system}, {"role": "user", "content": prompt}]


def _vllm(model: str, max_new_tokens: int, temperature: float, thinking: bool, options: dict) -> Generate:
    from vllm import LLM, SamplingParams

    llm, sampling = LLM(model=model, **options), SamplingParams(temperature=temperature, max_tokens=max_new_tokens)

    def generate(system: str, prompt: str) -> tuple[str, int, int]:
        got = llm.chat(_messages(system, prompt), sampling, use_tqdm=False, chat_template_kwargs={"enable_thinking": thinking})[0]
        return got.outputs[0].text, len(got.prompt_token_ids), len(got.outputs[0].token_ids)

    return generate


def _transformers(model: str, max_new_tokens: int, temperature: float, thinking: bool, options: dict) -> Generate:
    from transformers import AutoModelForCausalLM, AutoTokenizer

    tokenizer = AutoTokenizer.from_pretrained(model)
    network = AutoModelForCausalLM.from_pretrained(model, device_map="auto", **options)
    draw = {"do_sample": True, "temperature": temperature} if temperature > 0 else {"do_sample": False}

    def generate(system: str, prompt: str) -> tuple[str, int, int]:
        text = tokenizer.apply_chat_template(_messages(system, prompt), tokenize=False, add_generation_prompt=True, enable_thinking=thinking)
        ids = tokenizer(text, return_tensors="pt").to(network.device)
        size = ids["input_ids"].shape[1]
        new = network.generate(**ids, max_new_tokens=max_new_tokens, **draw)[0][size:]
        return tokenizer.decode(new, skip_special_tokens=True), size, len(new)

    return generate


ENGINES: dict[str, Callable[..., Generate]] = {"vllm": _vllm, "hf": _transformers}


def local_labeler(model: str = "", engine: str = "hf", max_new_tokens: int = 8192, temperature: float = 0.0, thinking: bool = True, load: Callable[[], Generate] | None = None, **options) -> ModelLabeler:
    """``options`` go to the engine (dtype, max_model_len, tensor_parallel_size and the like). ``load`` stands in for an engine."""
    if load is None and engine not in ENGINES:
        raise ValueError(f"no engine {engine!r}")

    def open_():
        generate = load() if load else ENGINES[engine](model, max_new_tokens, temperature, thinking, options)
        return lambda request: Reply(*generate(request.system, request.prompt))

    return ModelLabeler(model + ("" if thinking else "(no-think)"), open_, CANDIDATE_SYSTEM, model, engine, options=options)
