"""Deterministic responders for the tests, in place of a model service."""


class LetterResponder:
    """Answers ``X)`` with X = chr(65 + len(prompt) % n_letters)."""

    def __init__(self, n_letters: int = 4, **_):
        self.n_letters = n_letters

    def __call__(self, prompt: str) -> str:
        return chr(65 + len(prompt) % self.n_letters) + ")"


class FlakyResponder(LetterResponder):
    """Like ``LetterResponder`` but the first ``len(prompt) % 3`` calls for a row fail."""

    def attempt(self, prompt: str, number: int) -> str:
        if number <= len(prompt) % 3:
            raise ConnectionError("transient failure")
        return self(prompt)


class ModLoglikModel:
    """Deterministic stand-in for a language model's option scoring:
    loglik = -((len(context) + ord(continuation)) % 5)."""

    def __init__(self, **_):
        pass

    def loglik(self, contexts: list[str], continuations: list[str]) -> list[float]:
        return [-float((len(c) + ord(x)) % 5) for c, x in zip(contexts, continuations)]


class BatchLetterResponder(LetterResponder):
    """Engine-style responder: one call for a whole batch."""

    def batch(self, prompts: list[str]) -> list[str]:
        return [self(p) for p in prompts]
