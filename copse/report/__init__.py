"""Results as JSON, text, HTML and README sections; the only place where rows are collected."""
