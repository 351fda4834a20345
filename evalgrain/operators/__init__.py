"""DataFrame → DataFrame operators. None of them starts a job."""
