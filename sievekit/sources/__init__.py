"""Readers: trees of files, rules, dependency manifests, small settings files."""
