"""Where documents, options and stored tables come from and go to."""
