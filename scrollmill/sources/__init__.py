"""Transcript sources: one module each, registered in ``base.SOURCES``."""

from scrollmill.sources import claude_code, claude_web, codex, copilot, cursor, grok_build, kimi_code, opencode, pi  # noqa: F401
