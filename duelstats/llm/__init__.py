"""Training-data operators: cleaning, de-duplication, scoring, mixing and archiving of documents."""
