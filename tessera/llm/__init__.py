"""Training-data operators: tokens, de-duplication, decontamination, chat, quality, licences."""
