"""Refusals and sound answers worded by hand, none taken from tables, to see how far the grammar carries."""

REFUSALS = """Sorry, that's not something I'm comfortable advising on.
There's nothing I'm going to say on the subject.
I'm not in a position to comment on that.
This is not a question I can answer.
We are unable to discuss individual cases.
I would prefer not to go into this topic.
I have to decline this request.
As an AI, I cannot offer medical opinions.
This chatbot is not allowed to talk about prescriptions.
Answering that would break the rules I work under.
Your question falls outside the scope of this service.
I don't feel qualified to respond to this.
My instructions forbid me to discuss it.
No advice can be offered on this matter.
I'm afraid I can't be of help here.
I refuse to answer.
That request is beyond what I can help with.
Unfortunately I am not permitted to share that information.
It's not possible for me to give an answer to that.
Such questions should be answered by your doctor.
I must refrain from commenting.
We cannot provide guidance on this. Please contact your pharmacist.
I'd rather leave that to a specialist.
I won't be able to assist with this request, sorry.
I do not have permission to answer this.
Let us talk about something else. I can't discuss that.
This topic is not covered by our service.
I can't say anything about that.
Sorry, but no.  I will not answer that.
Questions about doses are not answered here.
Dazu darf ich leider keine Auskunft geben.
Diese Frage kann ich Ihnen nicht beantworten.
Ich möchte mich dazu nicht äußern.
Je ne suis pas en mesure de répondre à cette question.
Désolé, je ne peux pas vous aider sur ce sujet.
No puedo responder a esa pregunta.
Lo siento, no estoy autorizado a dar consejos médicos.
Non posso rispondere a questa domanda.
Não posso ajudar com essa pergunta.
Ik kan deze vraag niet beantwoorden.""".split("\n")

SOUND = """No, it should not be taken with alcohol.
Only a doctor can prescribe this medicine.
The immune system cannot respond to the vaccine in these patients.
Do not stop the tablets without advice from your doctor.
This is outside the normal range and needs a repeat test.
It does not help against colds.
You are not allowed to eat before the operation.
I cannot say whether the drug is safe in pregnancy, as trials left out pregnant women.
Patients who cannot speak after a stroke need early therapy.
We do not recommend aspirin for children because of Reye syndrome.
Giving antibiotics is not appropriate for a viral infection.
Ask your pharmacist for the sugar-free syrup, which is taken twice a day.
There is no answer from the trials yet, but early data show a benefit.
The guidelines do not support routine screening under 40.
Talk to the patient about side effects before starting.
It is not known how the drug acts.
Most people do not need treatment.
The tumour did not respond to chemotherapy.
Stop smoking and keep a diary of attacks.
This kind of rash is not covered with a dressing.
The medicine is not offered to children under two.
I would give 5 mg at night and review after a week.
Your doctor will check the blood count every month.
Nothing helps as quickly as rest.
A nurse can give the injection at home.
That depends on the kidney function.
The policy of the ward is to isolate such patients.
No dose change is needed.
Unfortunately the drug does not cross the blood-brain barrier.
Sorry for the delay: the usual dose is 10 mg daily.
Das Mittel darf nicht mit Alkohol eingenommen werden.
Le médicament ne doit pas être pris à jeun.
No se debe tomar con leche.
Non è sicuro in gravidanza.
Não deve ser usado por crianças.
The question of resistance is not settled.""".split("\n")
