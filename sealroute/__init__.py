"""Secure file exchange as Spark jobs: list, check, decrypt or encrypt, route, summarise."""
