"""DataFrame operators: profile, clean, encode, split, test, model, audit, report."""
