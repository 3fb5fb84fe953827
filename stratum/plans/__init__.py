"""Pipelines that turn raw security, accounting and bond tables into panels."""
