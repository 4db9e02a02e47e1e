"""SQL of the corpus problems' queries; encoding and scoring have none and are tested against other implementations."""

SQL: dict[str, str] = {}
