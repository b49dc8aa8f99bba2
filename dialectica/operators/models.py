"""Text models behind one hook: settings, loaders, and a deterministic stand-in for runs without a model.

A loader is a function without arguments that runs once in each Python worker and gives a function from a list of
prompts to the list of their answers; `generation.infer` takes loaders.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

#: Fixed value: the message that goes before every prompt.
SYSTEM_MESSAGE = "You generate structured recommendation arguments. You must answer with valid JSON only."
Model = Callable[[list[str]], list[str]]
#: Name of the stand-in, which is the default.
TEMPLATE = "template"


@dataclass(frozen=True)
class ModelConfig:
    """How texts are generated. Temperature and top_p count only with do_sample."""

    model_name: str = TEMPLATE
    max_new_tokens: int = 650
    temperature: float = 0.2
    top_p: float = 0.9
    do_sample: bool = False
    device_map: str = "auto"
    torch_dtype: str = "auto"

    def settings(self, pad: int | None = None) -> dict:
        """The settings of one call."""
        sampled = {"temperature": self.temperature, "top_p": self.top_p} if self.do_sample else {}
        return {"max_new_tokens": self.max_new_tokens, "do_sample": self.do_sample, **sampled, **({} if pad is None else {"pad_token_id": pad})}


#: Scoring answers are short.
SCORING = ModelConfig(max_new_tokens=300)


def messages(prompt: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": SYSTEM_MESSAGE}, {"role": "user", "content": prompt}]


class TemplateModel:
    """Answers a prompt for arguments with two supports and two attacks that quote its first history item and its target, and any other prompt with a valid score."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.arguments(p) if "\nARGUMENT:\n" not in p and "\nTARGET_ITEM:\n" in p else '{"score": 0.5, "reason": "template"}' for p in prompts]

    def arguments(self, prompt: str) -> str:
        history, _, target = prompt.partition("\nUSER_HISTORY:\n")[2].partition("\n\nTARGET_ITEM:\n")
        name = target.partition(" | categories: ")[0]
        seen = history[3:].partition(" | categories: ")[0] if history else "previous visits"
        said = [("A1", "support", f"{name} resembles {seen}.", seen), ("A2", "support", f"The history fits {name}.", f"history with {seen}"), ("A3", "attack", f"{name} may disappoint.", name), ("A4", "attack", f"Nothing else speaks for {name}.", name)]
        return json.dumps({"arguments": [{"id": i, "type": t, "text": s, "evidence": [e]} for i, t, s, e in said]}, ensure_ascii=False)


class ChatModel:
    """A causal language model of a public model library, if that is installed where the workers run."""

    def __init__(self, config: ModelConfig) -> None:
        from transformers import AutoModelForCausalLM, AutoTokenizer

        self.config = config
        self.tokenizer = AutoTokenizer.from_pretrained(config.model_name)
        self.model = AutoModelForCausalLM.from_pretrained(config.model_name, device_map=config.device_map, torch_dtype=config.torch_dtype)

    def answer(self, prompt: str) -> str:
        given = self.tokenizer.apply_chat_template(messages(prompt), tokenize=True, add_generation_prompt=True, return_tensors="pt", return_dict=True).to(self.model.device)
        made = self.model.generate(**given, **self.config.settings(self.tokenizer.eos_token_id))
        return self.tokenizer.decode(made[0][given["input_ids"].shape[-1] :], skip_special_tokens=True)

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


def loader(config: ModelConfig) -> Callable[[], Model]:
    """The loader of a model by its settings."""

    def load() -> Model:
        return TemplateModel() if config.model_name == TEMPLATE else ChatModel(config)

    return load
