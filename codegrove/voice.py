"""Spoken output on the driver, beside printed text.

Candidates are tried for the platform in order; the first usable one speaks. Trouble with
audio is logged, each message once, and never raised. Nothing here runs on executors.
"""

from __future__ import annotations

import importlib
import logging
import shutil
import subprocess
import sys
from dataclasses import dataclass

TIMEOUT_S = 30


class Once(logging.Filter):
    """Passes each message once, until forgotten."""

    def __init__(self):
        super().__init__()
        self.seen: set[str] = set()

    def filter(self, record: logging.LogRecord) -> bool:
        text = record.getMessage()
        known = text in self.seen
        self.seen.add(text)
        return not known

    def forget(self) -> None:
        self.seen.clear()


ONCE = Once()
log = logging.getLogger(__name__)
log.addFilter(ONCE)


@dataclass(frozen=True)
class Program:
    """A program that speaks its argument; its exit code does not matter."""

    name: str
    platform: str = ""  # prefix of sys.platform

    def usable(self, platform: str) -> bool:
        return platform.startswith(self.platform) and shutil.which(self.name) is not None

    def say(self, text: str) -> None:
        subprocess.run([self.name, text], timeout=TIMEOUT_S, capture_output=True)


@dataclass(frozen=True)
class Library:
    """A Python module with the interface of pyttsx3; importing it may fail in any way."""

    name: str

    def usable(self, platform: str) -> bool:
        try:
            return bool(importlib.import_module(self.name))
        except Exception:
            return False

    def say(self, text: str) -> None:
        engine = importlib.import_module(self.name).init()
        engine.say(text)
        engine.runAndWait()


#: What may speak, in order: (the platform's own, then the library, then a program found anywhere).
CANDIDATES = (Program("say", "darwin"), Program("espeak-ng", "linux"), Library("pyttsx3"), Program("espeak-ng"))


def backend(platform: str | None = None, candidates=CANDIDATES):
    """The first usable candidate, or None."""
    return next((c for c in candidates if c.usable(platform or sys.platform)), None)


def speak(text: str | None, candidates=CANDIDATES) -> bool:
    """Whether something was asked to speak and took the text. Blank text is not spoken."""
    if text is None or text.isspace() or text == "":
        return False
    chosen = backend(candidates=candidates)
    if chosen is None:
        log.warning("speech is off: none of %s is installed", ", ".join(dict.fromkeys(c.name for c in candidates)))
        return False
    try:
        chosen.say(text)
    except Exception as e:  # audio is an extra: whatever breaks in it stays in it
        log.warning("speech is off: %s broke down with %s", chosen.name, type(e).__name__)
        return False
    return True
