"""Spark-native scoring of mails, posts, media scores and sender claims for fraud."""
