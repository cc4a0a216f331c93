"""Sources: file trees, git history and blame, configuration."""
