"""Structured Streaming forms of the page-view and cart-action logs."""
