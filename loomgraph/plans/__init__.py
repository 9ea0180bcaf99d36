"""Driver-side plan control: sessions, shared storage, fix-point loops."""
