"""Native column expressions: text, labels and code elements."""
