"""Operators for training-data pipelines and their queries; nothing else imports this package."""
