"""Rule tables that results depend on. Order is priority."""

from __future__ import annotations

# fixed values: entry point path patterns and reasons, on repository-relative posix paths
ENTRY_PATHS = (
    (r"(^|/)pages/", "Next.js/Nuxt pages route entrypoint"),
    (r"(^|/)app/.*/(route|page|layout|loading|error|template|default)\.[tj]sx?$", "Next.js app router entrypoint"),
    (r"(^|/)test_[^/]*\.py$", "pytest test file"),
    (r"(^|/)[^/]*_test\.py$", "pytest test file"),
    (r"(^|/)tests?/", "test directory"),
    (r"(^|/)conftest\.py$", "pytest conftest"),
    (r"(^|/)__main__\.py$", "Python module entrypoint (python -m)"),
    (r"(^|/)setup\.py$", "Python package entrypoint"),
    (r"(^|/)manage\.py$", "Django management entrypoint"),
    (r"(^|/)index\.[tj]sx?$", "barrel / index entrypoint"),
    (r"(^|/)main\.[tj]sx?$", "front-end application entrypoint"),
)
# fixed values: decorator verbs after an object, and bare decorators
ENTRY_VERBS = ("route", "get", "post", "put", "delete", "patch", "options", "head", "websocket", "on_event", "exception_handler", "middleware", "command", "callback", "group", "task", "fixture", "event")
ENTRY_BARE = ("@task", "@fixture", "@event", "@shared_task", "@callback", "@command")
# fixed values: hosts of OpenAI-compatible endpoints
COMPATIBLE_HOSTS = {
    "api.openai.com": "openai",
    "api.deepseek.com": "deepseek",
    "api.groq.com": "groq",
    "api.x.ai": "xai",
    "api.together.xyz": "together",
    "api.fireworks.ai": "fireworks",
    "openrouter.ai": "openrouter",
    "api.perplexity.ai": "perplexity",
    "api.mistral.ai": "mistral",
}
# fixed values: local hosts
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
# fixed value: how a base URL is set
BASE_URL = r"""(?i)base[_]?url\s*[=:]\s*["']([^"']+)["']"""
# fixed values: imports and the marker each sets for its file
IMPORT_MARKERS = (
    (r"(?:from\s+anthropic\b|import\s+anthropic\b|@anthropic-ai/sdk)", "anthropic"),
    (r"""(?:from\s+openai\b|import\s+openai\b|from\s+["']openai["']|require\(\s*["']openai["']\s*\))""", "openai"),
    (r"(?:google\.generativeai|from\s+google\s+import\s+genai|import\s+google\.generativeai|@google/gen(?:erative-)?ai)", "google"),
    (r"(?:from\s+groq\b|import\s+groq\b|@ai-sdk/groq)", "groq"),
    (r"(?:from\s+mistralai\b|import\s+mistralai\b|@mistralai/)", "mistral"),
    (r"(?:from\s+cohere\b|import\s+cohere\b)", "cohere"),
)
# fixed values: call-site rules (pattern, provider, channel, import they need); provider "?" is decided by the file's base URL,
# "$1" is the pattern's group
SITE_RULES = (
    (r"(?:claude_code_sdk|claude_agent_sdk|@anthropic-ai/claude-code)", "anthropic", "cli", None),
    (r"""(?i)\bAgent\s*\([^)]*model\s*[=:]\s*["'](?:claude|opus|sonnet|haiku)""", "anthropic", "cli", None),
    (r"""(?:claude\s+--print|["']claude["']\s*,\s*["']--print["']|subprocess[.\w]*\([^)]*["']claude["'])""", "anthropic", "cli", None),
    (r"""subprocess[.\w]*\([^)]*["']([a-z0-9_]+)-cli["']""", "$1", "cli", None),
    (r"(?:langchain_anthropic|@langchain/anthropic|\bChatAnthropic\b)", "anthropic", "direct", None),
    (r"(?:langchain_openai|@langchain/openai|\bChatOpenAI\b)", "openai", "direct", None),
    (r"\b(?:Async)?Anthropic\s*\(", "anthropic", "direct", "anthropic"),
    (r"\b(?:Async)?OpenAI\s*\(", "?", "direct", "openai"),
    (r"\.messages\.create\b", "anthropic", "direct", "anthropic"),
    (r"\.chat\.completions\.create\b", "?", "direct", "openai"),
    (r"\.generate_content\b", "google", "direct", "google"),
    (r"api\.anthropic\.com", "anthropic", "direct", None),
    (r"api\.openai\.com", "openai", "direct", None),
    (r"generativelanguage\.googleapis\.com", "google", "direct", None),
    (r"api\.groq\.com", "groq", "direct", None),
    (r"api\.deepseek\.com", "deepseek", "direct", None),
    (r"api\.mistral\.ai", "mistral", "direct", None),
    (r"api\.x\.ai", "xai", "direct", None),
    (r"api\.cohere\.(?:com|ai)", "cohere", "direct", None),
)
# fixed values: severity of channels
SEVERITY = {"direct": 3, "local": 2, "cli": 1}
# fixed values: directories never scanned
SKIP_DIRS = (".git", "__pycache__", ".venv", "venv", "node_modules", "dist", "build", ".next", ".mypy_cache", ".pytest_cache")
