"""Relational operators over the models, and the analytical queries made of them."""
