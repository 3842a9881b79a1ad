"""Types, limits, patterns and weights that results depend on."""

LOW_VALUE_TYPES = [
    ("event_msg", "token_count"),
    ("event_msg", "patch_apply_end"),
    ("event_msg", "task_started"),
    ("event_msg", "task_complete"),
    ("event_msg", "web_search_end"),
    ("event_msg", "thread_goal_updated"),
    ("event_msg", "item_completed"),
    ("event_msg", "turn_aborted"),
    ("response_item", "reasoning"),
    ("response_item", "web_search_call"),
    ("response_item", "tool_search_output"),
    ("session_meta", None),
]
NOISE_TYPES = [
    ("event_msg", "token_count"),
    ("event_msg", "task_started"),
    ("event_msg", "task_complete"),
    ("event_msg", "web_search_end"),
    ("event_msg", "thread_goal_updated"),
    ("event_msg", "item_completed"),
    ("event_msg", "turn_aborted"),
    ("event_msg", "thread_rolled_back"),
    ("event_msg", "sub_agent_activity"),
    ("event_msg", "agent_reasoning"),
    ("response_item", "reasoning"),
    ("inter_agent_communication_metadata", None),
]
EVIDENCE_TYPES = [
    ("response_item", "function_call_output"),
    ("response_item", "custom_tool_call_output"),
    ("event_msg", "patch_apply_end"),
    ("event_msg", "mcp_tool_call_end"),
    ("event_msg", "image_generation_end"),
]
METADATA_TYPES = ["session_meta", "world_state", "turn_context"]
CURRENT_TYPES = ["session_meta", "turn_context", "response_item", "event_msg", "compacted", "world_state", "inter_agent_communication_metadata"]
KNOWN_TYPES = [*CURRENT_TYPES, "legacy"]
TOOL_OUTPUTS = ["function_call_output", "custom_tool_call_output"]

FULL_CHARS, HEAD_CHARS, TAIL_CHARS = 5000, 2500, 1500
TOOL_HEAD_CHARS, TOOL_TAIL_CHARS = 1200, 800
LARGE_PAYLOAD_BYTES = 16 * 1024
SCALAR_CHARS = 256

PROBLEM_WORDS = ["error", "failed", "failure", "exception", "traceback", "失败", "错误"]
#: Patterns as Python's re has them: \w, \s and \b know all of Unicode. functions.patterns spells them for Spark.
FILE_PATTERN = r"(?:(?:[A-Za-z]:\\|/)?[\w.\- ]+[\\/])?[\w.\-]+\.(?:py|ts|tsx|js|jsx|md|json|toml|yaml|yml|sql|txt)"
FILE_ENDINGS = ["py", "ts", "js", "md", "json", "toml", "yaml", "yml", "sql", "txt"]
#: Runs of white space in titles and summaries: Unicode's Latin part.
SPACES = r"[\x09-\x0D\x1C-\x20\x85\xA0]+"

#: kind, severity, pattern.
DETECTORS = [
    ("private_key", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("api_key", "critical", r"\b(?:sk|pk|rk|tvly|ghp|github_pat)_[A-Za-z0-9_\-]{16,}\b"),
    ("token_assignment", "high", r"""(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*['\"]?[^'\"\s]{8,}"""),
    ("email", "medium", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("windows_abs_path", "low", r"""\b[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\?)+"""),
    ("posix_abs_path", "low", r"""(?<![\w.-])/(?:Users|home|var|etc|tmp|opt|workspace|repo)/[^\s`'\"]+"""),
]
#: Strings of which a text with a match holds one.
DETECTOR_HINTS = {
    "private_key": ["PRIVATE KEY-----"],
    "api_key": ["sk_", "pk_", "rk_", "tvly_", "ghp_", "github_pat_"],
    "token_assignment": [":", "="],
    "email": ["@"],
    "windows_abs_path": [":\\"],
    "posix_abs_path": ["/Users/", "/home/", "/var/", "/etc/", "/tmp/", "/opt/", "/workspace/", "/repo/"],
}

EMBEDDING_TOKEN = r"[\p{L}\p{N}_.\-:/\\]+"
TERM = r"[\p{L}\p{N}]+"
HYBRID_WEIGHTS = {"fts": 0.65, "vector": 0.35, "same_project": 0.05, "exact_hint": 0.05}
KEEP_BY_PROFILE = {"core": 3, "evidence": 2, "forensic": 1}
#: For each tier, the profiles that cover it.
COVERED_BY = {"core": ["core", "evidence", "forensic"], "evidence": ["evidence", "forensic"], "forensic": ["forensic"]}
TIER_DAYS = {"core": 1, "evidence": 7, "forensic": 30}
EXPORT_PROFILES = {
    "full": {},
    "brief": {},
    "agent": {"exclude": ["reasoning"], "max_chars": 4000, "max_tool_chars": 1000, "tool_output": False, "reasoning": False},
    "review": {"max_chars": 8000, "max_tool_chars": 2000, "reasoning": False},
}
